"""A table that is written more than once: rows by key, in buckets, with a manifest for each version.

Rows lie in buckets by a hash of the key, a folder of Parquet files each. A commit writes new folders for the buckets that
it touches and then one manifest, a small JSON file that names every bucket's folder; untouched buckets keep theirs.
The manifest of version n is made by a rename that fails if n is there, so of two writers one wins and the other starts
again from what the first has written. Readers take the folders of one manifest, so they see one version whole; what a
writer left before its manifest is never read. A manifest has a line for each bucket, so choose buckets of some hundred
megabytes; only manifests pass the driver, never rows.
"""

from __future__ import annotations

import dataclasses
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has made this version."""


class Files:
    """What is needed of the shared file system, by Hadoop's interface, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway, self.folder = spark._jvm, spark.sparkContext._gateway, folder
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.path("")
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Writes the file whole or not at all; Conflict if there is one."""
        part = f"_part/{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        if self.fs.getScheme() == "file":
            local = lambda x: urlparse(self.path(x).toUri().toString()).path
            try:
                os.link(local(part), local(name))  # fails if there is one, unlike a local rename
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                self.fs.delete(self.path(part), False)
            return
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without options it doesn't overwrite
        try:
            context.rename(self.path(part), self.path(name), plain)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Manifest:
    version: int
    schema: str
    key: str
    buckets: int
    #: A bucket's folders: one, and one more for each append since it was written whole.
    folders: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    #: The last batch of each writer that counts its batches.
    batches: dict[str, int] = field(default_factory=dict)
    operation: str = "create"
    name: str | None = None
    at: float = 0.0

    @property
    def total(self) -> int:
        return sum(self.rows.values())

    def of(self, buckets) -> list[str]:
        return [f for b in buckets for f in self.folders.get(b, [])]

    def all(self) -> set[str]:
        return set(self.of(self.folders))


@dataclass
class Rules:
    """What rows must hold. checks: a name and a condition in SQL each; unique: columns besides the key whose values one row
    may have; required: columns that can't be null. created and updated name columns of times that the table keeps."""

    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    created: str | None = None
    updated: str | None = None


class KeyedTable:
    """The table in a folder. Writes return the version they made, or the version as it is where there was nothing to do."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules | None = None):
        self.spark, self.folder, self.rules, self.files = spark, folder, rules or Rules(), Files(spark, folder)
        #: Called before a manifest is made; tests stop a writer here.
        self.before_commit: Callable[[Manifest], None] = lambda m: None

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 16, rules: Rules | None = None) -> KeyedTable:
        """An empty table, where there is none yet."""
        table = cls(spark, folder, rules)
        if not table.versions():
            try:
                table._commit(Manifest(0, schema, key, buckets))
            except Conflict:
                pass  # another writer was first
        return table

    # Versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None, name: str | None = None) -> Manifest:
        """Of a version, of the version with a name, or of the last."""
        if name is not None:
            for v in reversed(self.versions()):
                if (m := self.manifest(v)).name == name:
                    return m
            raise KeyError(f"no version is named {name}")
        if version is None:
            version = max(self.versions())
        return Manifest(**json.loads(self.files.read(f"_versions/{version:020d}.json")))

    def history(self) -> DataFrame:
        """version, name, operation, rows, folders written by each version that is kept: a row a manifest."""
        out, before = [], set()
        for m in (self.manifest(v) for v in self.versions()):
            out.append((m.version, m.name, m.operation, m.total, len(m.all() - before)))
            before = m.all()
        return self.spark.createDataFrame(out, "version long, name string, operation string, rows long, written long")

    def read(self, version: int | None = None, name: str | None = None) -> DataFrame:
        """The table as of a version or name; the last by default."""
        m = self.manifest(version, name)
        return self._folders(m, m.all()).drop(BUCKET)

    def lookup(self, keys: list[Any], version: int | None = None) -> DataFrame:
        """Rows of some keys: only their buckets' files are opened, and row groups are skipped by the key's bounds and Bloom filter."""
        m = self.manifest(version)
        kind = self._schema(m)[m.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(m.key, kind)]))
        found = {str(r[0]) for r in asked.select(self._bucket(m)).distinct().collect()}
        return self._folders(m, m.of(found)).drop(BUCKET).filter(F.col(m.key).isin(keys))

    def fetch(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of any number of keys (a column of the key's name): their buckets' files, joined on the key."""
        m = self.manifest(version)
        asked = stored(keys.select(m.key).distinct().withColumn(BUCKET, self._bucket(m)))
        return self._folders(m, m.of(self._touched(m, asked))).drop(BUCKET).join(asked.select(m.key), m.key, "left_semi")

    def expire(self, keep: int = 10) -> list[int]:
        """Forgets all versions but the last `keep` and the named ones, with the folders that no other version has. Readers
        of a forgotten version fail, so keep as many as the longest query needs."""
        versions = self.versions()
        manifests = {v: self.manifest(v) for v in versions}
        gone = [v for v in versions[:-keep] if manifests[v].name is None]
        used = {f for v, m in manifests.items() if v not in gone for f in m.all()}
        for v in gone:
            self.files.delete(f"_versions/{v:020d}.json")
        for f in sorted({f for v in gone for f in manifests[v].all()} - used):
            self.files.delete(f)
        return gone

    # Writes

    def upsert(self, rows: DataFrame, *, order: str | None = None, writer: str | None = None, batch: int | None = None) -> tuple[int, DataFrame]:
        """Rows replace those of their keys; of a batch's rows of one key the last by `order` stays (without it,
        and among equals, any one, the same in every run). Returns the version and the refused rows, with their reasons.

        With writer and batch, a batch that this writer has committed already changes nothing.
        """
        return self._write(rows, order, writer, batch, "upsert")

    def insert(self, rows: DataFrame, *, order: str | None = None, writer: str | None = None, batch: int | None = None) -> tuple[int, DataFrame]:
        """Rows whose keys the table hasn't got; those it has stay as they are. Otherwise as upsert."""
        return self._write(rows, order, writer, batch, "insert")

    def append(self, rows: DataFrame, *, writer: str | None = None, batch: int | None = None) -> int:
        """Rows of keys that the table hasn't got, which the caller knows (a log): no bucket is read or written anew, and
        another writer's commit costs no more than the next manifest. Rules are not asked. compact() joins the files."""
        m = self.manifest()
        if writer is not None and m.batches.get(writer, -1) >= batch:
            return m.version
        shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema(m))).withColumn(BUCKET, self._bucket(m))
        made, counts = self._written(m, shaped, m.buckets)
        while True:
            m = self.manifest()
            if writer is not None and m.batches.get(writer, -1) >= batch:
                return m.version
            folders = m.folders | {b: m.folders.get(b, []) + [f"{made}/{BUCKET}={b}"] for b in counts}
            sizes = m.rows | {b: m.rows.get(b, 0) + n for b, n in counts.items()}
            try:
                return self._commit(dataclasses.replace(m, version=m.version + 1, folders=folders, rows=sizes, batches=m.batches | ({writer: batch} if writer is not None else {}), operation="append", name=None))
            except Conflict:
                continue

    def compact(self, most: int = 8) -> int:
        """Buckets of more than `most` folders are written whole."""
        while True:
            m = self.manifest()
            touched = sorted(b for b, f in m.folders.items() if len(f) > most)
            if not touched:
                return m.version
            try:
                return self._replace(m, touched, self._folders(m, m.of(touched)), "compact")
            except Conflict:
                continue

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys go (a column of the key's name)."""
        while True:
            m = self.manifest()
            gone = stored(keys.select(m.key).distinct().withColumn(BUCKET, self._bucket(m)))
            touched = self._touched(m, gone)
            if not touched:
                return m.version
            left = self._folders(m, m.of(touched)).join(gone.select(m.key), m.key, "left_anti")
            try:
                return self._replace(m, touched, left, "delete")
            except Conflict:
                continue

    def clear(self) -> int:
        while True:
            m = self.manifest()
            try:
                return self._commit(dataclasses.replace(m, version=m.version + 1, folders={}, rows={}, operation="clear", name=None))
            except Conflict:
                continue

    def name(self, name: str) -> int:
        """The table as it is, as a version of this name; a name that is there stays where it is."""
        while True:
            if any(self.manifest(v).name == name for v in self.versions()):
                return self.manifest(name=name).version
            m = self.manifest()
            try:
                return self._commit(dataclasses.replace(m, version=m.version + 1, operation="name", name=name))
            except Conflict:
                continue

    # Parts

    def _schema(self, m: Manifest) -> T.StructType:
        return T.StructType.fromDDL(m.schema)

    def _bucket(self, m: Manifest):
        return F.pmod(F.xxhash64(F.col(m.key).cast("string")), F.lit(m.buckets)).cast("int").alias(BUCKET)

    def _folders(self, m: Manifest, folders) -> DataFrame:
        schema, paths = self._schema(m), sorted(f"{self.folder}/{f}" for f in folders)
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn(BUCKET, self._bucket(m))

    def _touched(self, m: Manifest, rows: DataFrame) -> list[str]:
        """Buckets of rows that the table has a folder for."""
        return sorted({str(r[0]) for r in rows.select(BUCKET).distinct().collect()} & m.folders.keys())

    def _judged(self, m: Manifest, rows: DataFrame, order: str | None) -> DataFrame:
        """rows with reasons: conditions that aren't held, and keys that repeat inside the batch. A key may have any share
        of the rows: one row a key is found by partial aggregates and met by its own number."""
        rules, c = self.rules, F.col
        columns = self._schema(m).names
        reasons = [F.when(c(m.key).isNull(), F.lit(f"{m.key} is null"))]
        reasons += [F.when(c(x).isNull(), F.lit(f"{x} is null")) for x in rules.required if x != m.key]
        reasons += [F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(f"check {name}")) for name, sql in rules.checks.items()]
        out = stored(rows.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("_row", F.monotonically_increasing_id()))
        last = F.struct(*([order] if order else []), F.md5(F.to_json(F.struct(*columns))), "_row")
        winners = out.filter("size(reasons) = 0").groupBy(m.key).agg(F.max_by("_row", last).alias("_row")).withColumn("_wins", F.lit(True))
        met = out.join(winners, [m.key, "_row"], "left")
        return met.withColumn("reasons", F.when((F.size("reasons") == 0) & F.isnull("_wins"), F.array(F.lit(f"{m.key} repeats"))).otherwise(c("reasons"))).select(*columns, "reasons")

    def _unique(self, m: Manifest, rows: DataFrame, column: str, operation: str) -> DataFrame:
        """Refuses rows whose value of a unique column another row has: in the batch, where the least key stays, or in the
        table under another key. Rows that an upsert replaces give their values up."""
        fine = (F.size("reasons") == 0) & F.col(column).isNotNull()
        least = rows.filter(fine).groupBy(column).agg(F.min(m.key).alias(m.key)).withColumn("_first", F.lit(True))
        met = stored(rows.join(least, [column, m.key], "left").withColumn("_fine", fine))
        have = self._folders(m, m.all()).select(column, F.col(m.key).alias("_owner"))
        if operation == "upsert":
            have = have.join(rows.select(F.col(m.key).alias("_owner")).distinct(), "_owner", "left_anti")
        firsts = met.filter("_fine and _first")
        taken = have.join(firsts.select(column), column, "left_semi").groupBy(column).agg(F.min("_owner").alias("_owner"))
        late = F.array(F.lit(f"{column} is taken"))
        other = F.col("_owner").isNotNull() & (F.col("_owner") != F.col(m.key))
        one = firsts.join(taken, column, "left").withColumn("reasons", F.when(other, late).otherwise(F.col("reasons")))
        rest = met.filter("not (_fine and coalesce(_first, false))").withColumn("reasons", F.when(F.col("_fine"), late).otherwise(F.col("reasons")))
        return one.select(*rows.columns).unionByName(rest.select(*rows.columns))

    def _write(self, rows: DataFrame, order: str | None, writer: str | None, batch: int | None, operation: str) -> tuple[int, DataFrame]:
        if (writer is None) != (batch is None):
            raise ValueError("a counted batch needs both its writer and its number")
        while True:
            m = self.manifest()
            schema, created = self._schema(m), self.rules.created
            if writer is not None and m.batches.get(writer, -1) >= batch:
                return m.version, self.spark.createDataFrame([], self._schema(m).add("reasons", T.ArrayType(T.StringType())))
            shaped = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), *([order] if order and order not in schema.names else []))
            judged = self._judged(m, shaped, order)
            for column in self.rules.unique:
                judged = self._unique(m, stored(judged), column, operation)
            judged = stored(judged)
            refused, good = judged.filter("size(reasons) > 0"), judged.filter("size(reasons) = 0").drop("reasons").withColumn(BUCKET, self._bucket(m))
            if operation == "insert":
                have = self._folders(m, m.of(self._touched(m, good)))
                good = stored(good.join(have.select(m.key), m.key, "left_anti"))
            touched = sorted({str(r[0]) for r in good.select(BUCKET).distinct().collect()})
            old = self._folders(m, m.of(touched))
            now = F.current_timestamp().cast("timestamp_ntz")
            if created:
                before = old.select(m.key, F.col(created).alias("_created"))
                good = good.join(before, m.key, "left").withColumn(created, F.coalesce("_created", created, now)).drop("_created")
            if self.rules.updated:
                good = good.withColumn(self.rules.updated, now)
            names = [*schema.names, BUCKET]
            new = old.join(good.select(m.key), m.key, "left_anti").select(*names).unionByName(good.select(*names))
            if not touched and writer is None:
                return m.version, refused
            try:
                return self._replace(m, touched, new, operation, {writer: batch} if writer is not None else {}), refused
            except Conflict:
                continue

    def _written(self, m: Manifest, rows: DataFrame, tasks: int) -> tuple[str, dict[str, int]]:
        """Writes rows by bucket in a new folder; returns it, and the rows of each bucket."""
        made = f"data/{uuid.uuid4().hex}"
        dealt = rows.repartition(max(1, tasks), BUCKET).sortWithinPartitions(BUCKET, m.key)
        dealt.write.partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{m.key}", "true").option("compression", "zstd").parquet(f"{self.folder}/{made}")
        if not any("=" in n for n in self.files.names(made)):
            return made, {}
        written = self.spark.read.schema(T.StructType([T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.folder}/{made}")
        return made, {str(r[0]): r[1] for r in written.groupBy(BUCKET).count().collect()}

    def _replace(self, m: Manifest, touched: list[str], rows: DataFrame, operation: str, batches: dict[str, int] | None = None) -> int:
        """Writes the touched buckets anew, and the manifest of the next version."""
        made, counts = self._written(m, rows, len(touched)) if touched else ("", {})
        folders = {b: f for b, f in m.folders.items() if b not in touched} | {b: [f"{made}/{BUCKET}={b}"] for b in counts}
        sizes = {b: n for b, n in m.rows.items() if b not in touched} | counts
        return self._commit(dataclasses.replace(m, version=m.version + 1, folders=folders, rows=sizes, batches=m.batches | (batches or {}), operation=operation, name=None))

    def _commit(self, m: Manifest) -> int:
        self.before_commit(m)
        self.files.write_new(f"_versions/{m.version:020d}.json", json.dumps(dataclasses.asdict(dataclasses.replace(m, at=time.time()))))
        return m.version
