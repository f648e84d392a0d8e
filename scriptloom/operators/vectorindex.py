"""Search among vectors: exact by blocks of queries, and by an inverted file of cells.

Exact search sends the queries to the tasks, in groups of bounded size, and no vector is shuffled: each batch of vectors
is multiplied with the queries, block by block, and only what comes up to the k best so far goes on. The index has a cell for each centre of a k-means
run on a bounded sample. Every vector lies in the folder of its nearest centre, with its residual in eight bits a
dimension beside the full vector. A search ranks the codes of the nearest cells and scores the best of them exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of queries that are sent to the tasks at once; more queries are searched in several passes.
QUERY_BYTES = 8 << 20
#: Values of the column `per` whose best scores so far a task remembers; with more it begins anew, which costs only rows.
KINDS = 8
#: Scores that a task holds at once, hits that it scores exactly at once, and vectors that meet the queries together.
SCORES, HITS, VECTORS = 1 << 21, 1 << 15, 4096
#: Vectors that the centres are fitted on, at most (a sample by hash of the id), and rounds.
SAMPLE, ROUNDS, MOST_CELLS = 65_536, 10, 4096
#: Hits by codes that are scored exactly, for each that is asked for.
RESCORED = 8


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as float64 rows; all lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, added up in order of the dimensions, as SQL does; rows of length 0 stay."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total = total + x[:, k] * x[:, k]
    size = np.sqrt(total)
    return np.where(size[:, None] > 0, x / np.where(size > 0, size, 1)[:, None], x)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of row pairs, added up in order of the dimensions."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total = total + a[:, k] * b[:, k]
    return total


def query_groups(queries: DataFrame) -> list[DataFrame]:
    """query_id and q in groups of bounded bytes, dealt by hash, so that the driver holds one group at a time."""
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    parts = max(1, -(-(size[0] or 0) * (size[1] or 0) * 8 // QUERY_BYTES))
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) for p in range(parts)]


def collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow()
    return table.column("query_id").to_numpy(), normalised(matrix(table.column("q")))


def _top(score: np.ndarray, k: int, floor: np.ndarray | None = None) -> np.ndarray:
    """For each row (query) which columns can be among its k best: all that come up to the k-th, and to a floor, within rounding."""
    least = np.full(len(score), -np.inf) if floor is None else floor
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
    return score >= least[:, None] - 1e-9


def _hits(ids: np.ndarray, q: np.ndarray, v: np.ndarray, vec_id: np.ndarray, k: int, least: float | None, kept: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of v for each query that aren't worse than its k best so far: which query, which vector, score. kept has
    the scores of the k best so far and is brought up to date. No more than SCORES scores and HITS exact ones are held, but for
    vectors that tie."""
    step = max(1, min(SCORES // len(v), HITS // k))
    for lo in range(0, len(ids), step):
        some, own = q[lo : lo + step], kept[lo : lo + step]
        which, hit = np.nonzero(_top(some @ v.T, k, own.min(axis=1)))
        exact = np.concatenate([dots(some[which[a : a + HITS]], v[hit[a : a + HITS]]) for a in range(0, len(hit), HITS)] or [np.zeros(0)])
        by = np.lexsort((vec_id[hit], -exact, which))
        first = np.searchsorted(which, np.arange(len(some)))
        rank = np.arange(len(by)) - first[which]  # which is in order, and stays so
        which, hit, exact = which[by], hit[by], exact[by]
        go = (rank < k) if least is None else (rank < k) & (exact >= least)
        which, hit, exact, rank = which[go], hit[go], exact[go], rank[go]
        new = np.full((len(some), k), -np.inf)
        new[which, rank] = exact
        kept[lo : lo + step] = np.partition(np.concatenate([own, new], axis=1), k, axis=1)[:, k:]
        if len(hit):
            yield lo + which, hit, exact


def best(queries: DataFrame, vectors: DataFrame, k: int, *, per: str | None = None, least: float | None = None) -> DataFrame:
    """The k best vectors (vec_id, v and other columns) of each query (query_id, q), by cosine, then by vec_id: query_id,
    score and the vectors' other columns. With `per`, the k best of each value of that column. Scores are those of a sum in
    order of the dimensions, bit for bit. Null vectors are never found; vectors of length 0 score 0."""
    spark = vectors.sparkSession
    names = [c for c in vectors.columns if c != "v"]
    rows = vectors.filter("v is not null").withColumn("v", F.col("v").cast("array<double>"))
    out = None
    for group in query_groups(queries):
        sent = spark.sparkContext.broadcast(collected(group))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            if not len(ids):
                return
            kept: dict[object, np.ndarray] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, VECTORS):
                    batch = whole.slice(at, VECTORS)
                    v, vec_id = normalised(matrix(batch.column("v"))), batch.column("vec_id").to_numpy(zero_copy_only=False)
                    kinds = batch.column(per).to_numpy(zero_copy_only=False) if per else np.zeros(batch.num_rows)
                    for kind in dict.fromkeys(kinds.tolist()):
                        mine = np.flatnonzero(kinds == kind) if kind is not None else np.flatnonzero([x is None for x in kinds])
                        if kind not in kept and len(kept) == KINDS:
                            kept.clear()
                        so_far = kept.setdefault(kind, np.full((len(ids), k), -np.inf))
                        for which, hit, exact in _hits(ids, q, v[mine], vec_id[mine], k, least, so_far):
                            found = batch.take(pa.array(mine[hit]))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), *(found.column(c) for c in names), pa.array(exact)], ["query_id", *names, "score"])

        schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "v"), "score double"])
        hits = rows.select(*names, "v").mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    order = W.partitionBy("query_id", *([per] if per else [])).orderBy(F.desc("score"), "vec_id")
    return out.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def centres(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """k-means on unit vectors: the start is a choice of the sample, empty cells take the worst placed vectors."""
    r = np.random.default_rng(seed)
    c = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        score = sample @ c.T
        cell, fit = score.argmax(axis=1), score.max(axis=1)
        n = np.bincount(cell, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, cell, sample)
        c = normalised(np.where(n[:, None] > 0, total, 0))
        empty = np.flatnonzero(n == 0)
        c[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
    return c


@dataclass
class VectorIndex:
    """An index in a folder: its centres, and its vectors by cell."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """Every vector (vec_id, v and other columns) in the cell of its nearest centre; null vectors are left out. By default
        there are as many cells as the square root of the vectors' number, 4,096 at most. The centres are fitted on at most
        65,536 vectors, those of least hash of the id."""
        spark = vectors.sparkSession
        rows = vectors.filter("v is not null").withColumn("v", F.col("v").cast("array<float>"))
        n = rows.count()
        cells = min(cells or int(n**0.5) + 1, MOST_CELLS, max(n, 1))
        share = min(1.0, 1.1 * SAMPLE / max(n, 1))  # so that only about the sample's rows are sorted
        chance = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_003)) / 1_000_003
        sample = rows.filter(chance <= share).orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(SAMPLE).select("v").toArrow()
        middle = centres(normalised(matrix(sample.column("v"))), cells) if sample.num_rows else np.zeros((0, 0))
        spark.createDataFrame([(json.dumps({"cells": middle.tolist()}),)], "value string").coalesce(1).write.text(f"{folder}/centres")
        sent = spark.sparkContext.broadcast(middle)
        names = rows.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = normalised(matrix(batch.column("v")))
                    cell = (v @ sent.value.T).argmax(axis=1)
                    rest = v - sent.value[cell]
                    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                    code = np.rint(rest / scale[:, None]).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(cell.astype(np.int32))], [*names, "_code", "_scale", "_cell"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_code binary", "_scale float", "_cell int"])
        placed = rows.mapInArrow(place, schema)
        # a cell may hold any share of the vectors, so it is dealt to several tasks by the id
        spread = F.pmod(F.xxhash64("vec_id"), F.lit(4))
        placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_cell", spread).sortWithinPartitions("_cell").write.partitionBy("_cell").parquet(f"{folder}/vectors")
        return cls(spark, folder)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """The share of the exact k best that a search finds."""
        want = best(queries, self.vectors().drop("_code", "_scale", "_cell"), k).select("query_id", "vec_id")
        found = self.search(queries, k, probes=probes).select("query_id", "vec_id").distinct()
        return found.join(want, ["query_id", "vec_id"], "left_semi").count() / max(1, want.distinct().count())

    def tuned(self, queries: DataFrame, k: int, target: float = 0.9) -> int:
        """The least number of probes, doubling from 4, whose recall over these queries (a few hundred will do) is the target."""
        probes = 4
        while probes < MOST_CELLS and self.recall(queries, k, probes) < target:
            probes *= 2
        return probes

    def search(self, queries: DataFrame, k: int, *, probes: int = 16, exact: bool = False) -> DataFrame:
        """The k best of each query (query_id, q) among the vectors of its nearest cells; `exact` looks into all of them and
        is the same as best()."""
        rows = self.vectors()
        plain = rows.drop("_code", "_scale", "_cell")
        if exact:
            return best(queries, plain, k)
        middle = np.array(json.loads(self.spark.read.text(f"{self.folder}/centres").first()[0])["cells"])
        found = None
        for group in query_groups(queries):
            ids, q = collected(group)
            near = np.argsort(-(q @ middle.T), axis=1, kind="stable")[:, :probes] if len(ids) else np.zeros((0, 1), np.int64)
            by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            sent = self.spark.sparkContext.broadcast((ids, q, middle, by_cell))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q, middle, by_cell = sent.value
                for batch in batches:
                    cells = batch.column("_cell").to_numpy()
                    for c in np.unique(cells).tolist():
                        asked = by_cell.get(c)
                        if asked is None:
                            continue
                        mine = batch.filter(pa.array(cells == c))
                        code = np.frombuffer(b"".join(x.as_py() for x in mine.column("_code")), np.int8).reshape(mine.num_rows, -1)
                        v = middle[c] + code * mine.column("_scale").to_numpy().astype(np.float64)[:, None]
                        step = max(1, SCORES // mine.num_rows)
                        for at in range(0, len(asked), step):
                            some = asked[at : at + step]
                            which, hit = np.nonzero(_top(q[some] @ v.T, RESCORED * k))
                            rough = np.einsum("ij,ij->i", q[some][which], v[hit])
                            yield pa.RecordBatch.from_arrays([pa.array(ids[some[which]]), mine.column("vec_id").take(pa.array(hit)), pa.array(np.full(len(hit), c, np.int32)), pa.array(rough)], ["query_id", "vec_id", "_cell", "rough"])

            kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, _cell int, rough double"
            probed = rows.filter(F.col("_cell").isin([int(c) for c in np.unique(near)])) if len(ids) else rows.limit(0)
            hits = probed.select("vec_id", "_cell", "_code", "_scale").mapInArrow(run, kinds)
            found = hits if found is None else found.unionByName(hits)
        first = found.withColumn("_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id"))).filter(F.col("_rank") <= RESCORED * k)
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
        pairs = first.select("query_id", "vec_id", "_cell").join(rows.drop("_code", "_scale"), ["vec_id", "_cell"]).join(asked, "query_id").drop("_cell")
        names = [c for c in pairs.columns if c not in ("q", "v")]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    value = dots(normalised(matrix(batch.column("q"))), normalised(matrix(batch.column("v"))))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(value)], [*names, "score"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in names), "score double"])
        scored = pairs.mapInArrow(score, schema)
        return scored.withColumn("_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_rank") <= k).drop("_rank")
