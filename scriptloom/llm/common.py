"""What the operators of this subpackage share: tables, shared storage, and polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored  # noqa: F401

#: What stands for a null key among longs.
NULL_KEY = -(1 << 63)
#: Odd multiplier of the polynomial hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most `limit` bytes of a string or binary column; a longer row is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and where each row starts (with the end); null counts as empty."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i to n at least."""
    if not _powers or max(_powers) <= n:
        size = 1 << max(12, int(n).bit_length())
        _powers.clear()
        both = []
        for base in (BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = (both[0], both[1])
    return next(iter(_powers.values()))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[x] * BASE**x over i <= x < j, mod 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of each span, the same wherever the span stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x + np.uint64((seed * BASE + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, from the finaliser above.
BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64), 1)


def words_of(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that aren't spaces, cut at rows), and the first word of each row (with the end)."""
    gap = is_space[data]
    first = np.ones(len(data), bool)
    first[1:] = gap[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = True
    last[cuts[cuts > 0] - 1] = True
    start = np.flatnonzero(first & ~gap)
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(start, offsets)


#: Longer words are hashed by blake2b: polynomials mod 2**64 agree on some pairs of different words from about 1,000 bytes on.
LONG_WORD = 128


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = mixed(span_hashes(prefix_hashes(BYTE_VALUES[data]), start, end) + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: edges (a, b) of longs; returns (id, root), root the smallest id that is reachable.

    Alternates hooking to the smallest neighbour and pointer jumping; a vertex sends one row per edge, groups are
    reduced before they are shuffled, and each round is written to the shared folder. Loops and repeated edges do
    no harm; no edges give no rows. Components that need more rounds are an error.
    """
    spark = edges.sparkSession
    live = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    vertices = live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    forest = None
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        # each vertex points to its smallest neighbour or itself: a forest; two jumps shorten it
        low = stored(low)
        for _ in range(2):
            up = low.select(F.col("id").alias("p"), F.col("p").alias("q"))
            low = low.join(up, "p").select("id", F.col("q").alias("p"))
        low = stored(low)
        ids = low.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        half = live.join(ids, "a").select("b", "pa")
        live = stored(half.join(ids.toDF("b", "pb"), "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if forest is None:
            forest = low
        else:
            up = low.select(F.col("id").alias("p"), F.col("p").alias("q"))
            forest = stored(forest.join(up, "p", "left").select("id", F.coalesce("q", "p").alias("p")))
    if not live.isEmpty():
        raise RuntimeError(f"components were not found in {rounds} rounds")
    if forest is None:
        return spark.createDataFrame([], "id long, root long")
    least = forest.groupBy("p").agg(F.min("id").alias("root"))
    return vertices.join(forest, "id").join(least, "p").select("id", "root")


def summed_slices(rows: DataFrame, combine: str = "sum", kind: type = np.int64) -> dict[int, np.ndarray]:
    """Sums (or ors) arrays that tasks send in slices: rows have slice, salt (any spread) and data (bytes of `kind`).
    Two levels of grouping, so no task combines more than a share of the tasks' arrays; returns the slices as int64."""

    def one(table: pa.Table) -> pa.Table:
        total, sent = None, kind if "salt" in table.column_names else np.int64
        for x in table.column("data").to_pylist():
            x = np.frombuffer(x, sent).astype(np.int64)
            total = x if total is None else total + x if combine == "sum" else total | x
        return pa.Table.from_pydict({"slice": table.column("slice")[:1].combine_chunks().cast(pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    first = rows.groupBy("slice", "salt").applyInArrow(one, "slice long, data binary")
    return {r["slice"]: np.frombuffer(bytes(r["data"]), np.int64) for r in first.groupBy("slice").applyInArrow(one, "slice long, data binary").collect()}


#: Most keys for which a Bloom filter (16 bits each, so 32 MB at most) is sent to the tasks; beyond, rows are only joined.
BLOOM_KEYS = 16_000_000


def bloom_of(keys: DataFrame):
    """A test for arrays of longs that holds for all of keys' first column and for about 1 in 500 others; None if there are too many keys."""
    spark = keys.sparkSession
    n = keys.count()
    if n > BLOOM_KEYS:
        return None
    bits = max(12, int(16 * n).bit_length())
    pieces = 1 << max(0, bits - 21)
    name = keys.columns[0]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                table[at] = True
        for k, part in enumerate(np.split(np.packbits(table), pieces)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "salt": pa.array([TaskContext.get().partitionId() % 64], pa.int64()), "data": pa.array([part.tobytes()], pa.binary())})

    found = summed_slices(keys.select(F.col(name).cast("long")).filter(F.col(name).isNotNull()).mapInArrow(mark, "slice long, salt long, data binary"), "or")
    size = (1 << bits) // 8 // pieces
    whole = np.concatenate([found[k].view(np.uint8) if k in found else np.zeros(size, np.uint8) for k in range(pieces)])
    sent = spark.sparkContext.broadcast(whole)

    def test(values: np.ndarray) -> np.ndarray:
        table, hit = sent.value, np.ones(len(values), bool)
        for at in bloom_places(values, bits):
            hit &= (table[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return hit

    return test


def bloom_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    x = values.astype(np.int64).view(np.uint64)
    return [(mixed(x, 11 + k) >> np.uint64(64 - bits)).astype(np.int64) for k in range(4)]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
