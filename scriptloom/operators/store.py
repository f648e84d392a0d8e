"""The sample store: inserts of what is absent, look-ups, snapshots, and files."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup


def cleaned(rows: DataFrame) -> DataFrame:
    """content without NUL characters, and the hash of what is left."""
    return rows.withColumn("content", F.replace("content", F.lit("\x00"), F.lit(""))).withColumn("content_hash", F.sha2("content", 256))


def new_rows(batch: DataFrame, store: DataFrame) -> DataFrame:
    """What an insert adds: the first of each hash in the batch that the store hasn't got."""
    return dedup.absent(dedup.exact(batch), store)


def insert_report(batch: DataFrame, store: DataFrame) -> DataFrame:
    full = batch.filter(F.col("content") != "")
    total = full.agg(F.count(F.lit(1)).alias("total"))
    return new_rows(batch, store).agg(F.count(F.lit(1)).alias("added")).join(total).select("added", (F.col("total") - F.col("added")).alias("duplicates"), "total")


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order; an offset counts only with a limit."""
    out = rows.orderBy(*order)
    return out.offset(offset).limit(limit) if limit is not None else out


def fetch(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def snapshot(stats: DataFrame, versions: DataFrame, version: Column) -> DataFrame:
    """The statistics as a version, unless there is one of that name."""
    return stats.withColumn("version", version).join(versions.select("version"), "version", "left_anti")


def file_name(source: Column, stamp: Column, name: Column) -> Column:
    return F.concat_ws("_", source, stamp, F.translate(name, "/\\", "__"))


def write_jsonl(rows: DataFrame, path: str, label: str | None = None) -> None:
    (rows.filter(F.col("label") == label) if label else rows).select("content", "label", "source").write.mode("overwrite").json(path)


def write_files(rows: DataFrame, folder: str, stamp: str, name: str = "file_name") -> DataFrame:
    """Writes each row's content to a file of its own and returns the files' paths. folder must be shared by all executors.

    A file is written under another name and then renamed, so a task that runs again leaves whole files; rows of the same
    source and name end as one file. A null source is `unknown`, a null name sample_<id>, a null content an empty file.
    """
    named = rows.select(file_name(F.coalesce("source", F.lit("unknown")), F.lit(stamp), F.coalesce(name, F.concat(F.lit("sample_"), F.col("id").cast("string")))).alias("path"), F.coalesce("content", F.lit("")).alias("content"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            paths = [f"{folder}/{n}" for n in b.path]
            for path, content in zip(paths, b.content, strict=True):
                part = f"{folder}/.{uuid.uuid4().hex}"
                Path(part).write_bytes(content.encode("utf-8", "ignore"))
                os.replace(part, path)
            yield pd.DataFrame({"path": paths})

    return named.mapInPandas(write, "path string")


def write_report(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as a file of YAML in its JSON form: a list of named values. More than `most` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in found], indent=2, default=str) + "\n", encoding="utf-8")


def refresh(stats: DataFrame, folder: str) -> None:
    """Writes the statistics anew beside the older ones, so that readers of those are not disturbed."""
    stats.write.parquet(f"{folder}/refresh={time.time_ns()}")


def refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of the last refresh."""
    all_ = spark.read.option("basePath", folder).parquet(folder)
    last = all_.agg(F.max("refresh")).first()[0]
    return all_.filter(F.col("refresh") == last).drop("refresh")


def save_artifact(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_artifact(spark: SparkSession, path: str) -> DataFrame:
    """What was saved, in the folder or in those below it."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def upserted(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store after an upsert: rows' keys replace the store's."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def knowledge_points(rows: DataFrame, force_type: str | None = None) -> DataFrame:
    """Rows with a description as points: id given or md5 of the description, defaults filled in, the last of an id stays."""
    kept = rows.filter(F.coalesce(F.trim("description"), F.lit("")) != "")
    out = kept.withColumn("point_id", F.coalesce("point_id", F.md5("description"))).withColumn("severity", F.coalesce("severity", F.lit("UNKNOWN"))).withColumn("type", F.lit(force_type) if force_type else F.coalesce("type", F.lit("vulnerability")))
    return out.groupBy("point_id").agg(F.max_by(F.struct("description", "severity", "type"), "seq").alias("r")).select("point_id", "r.*")
