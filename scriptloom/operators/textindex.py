"""A trigram index of texts on disk, and substring search by it.

The index has two tables. Texts are cut into blocks of some megabytes; a block's rows are numbered, and its lower-cased
texts' trigrams give postings: for each trigram of a block the numbers of the rows that have it, as differences in bytes
of seven bits. A frequent trigram so has a row for each block, never one row for all. Postings lie in folders by a hash
of the trigram, sorted, with a Bloom filter, so a search opens the folders of its trigrams only; texts lie in folders by
the task that wrote them, block after block in row groups of a block's size, so only row groups with candidates are read, and none
if a trigram is absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Bytes of a block, about; a longer text is a block of its own.
BLOCK = 4 << 20
#: Folders of postings.
BUCKETS = 64
#: Rare trigrams of a needle whose postings are intersected; the text decides the rest.
RAREST = 4
#: Postings of a block with more rows than this are dealt to so many tasks a folder, by block, so that no task writes all of a
#: frequent trigram's, and a folder gets few files however many tasks there are.
FREQUENT, SPREAD = 256, 4
#: Bytes of a file's Bloom filter: some 10,000 trigrams at one in a hundred. Spark's own size is a megabyte a file.
BLOOM = 16 << 10
#: Characters whose trigrams are sorted at once.
SORTED = 1 << 19
#: The index's own columns of the texts.
OWN = ("_block", "_at", "_part")
#: Blocks that are named in the scan's filter; more are joined, and pruned as the scan runs.
NAMED_BLOCKS = 10_000


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, as whole numbers of three times 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42) if len(c) > 2 else np.zeros(0, np.int64)


@F.pandas_udf(T.IntegerType())
def trigram_count(low: pd.Series, length: pd.Series) -> pd.Series:
    """How many distinct trigrams begin in a lower-cased text before its last two characters, whose number is that of the text
    before it was lower-cased; null for null. One sort of a text's trigrams, so linear in its length but for that."""

    def one(x: str, n: int) -> int:
        return len(trigrams(x[:n])) + len({x[i : i + 3] for i in range(max(0, len(x) - 2), n - 2)})

    return pd.Series([None if x is None else one(x, int(n)) for x, n in zip(low, length, strict=True)], dtype="Int32")


def trigram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of each text, as pairs of a trigram (a number as above) and its text's place in the list, in order."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    used = np.zeros(0x110000, np.int32)
    used[codes] = 1
    alphabet = np.flatnonzero(used)
    used[alphabet] = np.arange(len(alphabet))
    bits, low = max(0, len(alphabet) - 1).bit_length(), max(0, len(texts) - 1).bit_length()
    if 3 * bits + low > 63:  # one text always fits
        half = len(texts) // 2
        (g, r), (h, q) = trigram_rows(texts[:half]), trigram_rows(texts[half:])
        g, r = np.append(g, h), np.append(r, q + half)
        by = np.lexsort((r, g))
        return g[by], r[by]
    dense, row, keys = used[codes], np.repeat(np.arange(len(texts), dtype=np.int32), size), [np.zeros(0, np.int64)]
    for x in range(0, len(codes) - 2, SORTED):
        c, r = dense[x : x + SORTED + 2].astype(np.int64), row[x : x + SORTED + 2]
        key = np.sort(((c[2:] << 2 * bits | c[1:-1] << bits | c[:-2]) << low | r[:-2])[r[:-2] == r[2:]])
        keys.append(key[np.append(True, key[1:] != key[:-1])[: len(key)]])
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    of, mask = key >> low, (1 << bits) - 1
    if not len(key):
        return key, key
    return alphabet[of & mask] | alphabet[of >> bits & mask] << 21 | alphabet[of >> 2 * bits] << 42, key & ((1 << low) - 1)


def packed_lists(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ascending numbers, one after the other, that begin at the places first: the differences in each, seven bits a
    byte, low first; the last byte of each number has the high bit. Their bytes, and where each list's bytes begin and the last ends."""
    left = np.diff(numbers, prepend=0)
    left[first] = numbers[first]
    left = left.astype(np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 9):
        size += left >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    at = ends - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = (left[has] >> np.uint64(7 * k)).astype(np.uint8) & 127
    out[ends - 1] |= 128
    return out, np.append(at[first], len(out))


def packed(numbers: np.ndarray) -> bytes:
    return packed_lists(numbers, np.zeros(min(1, len(numbers)), np.int64))[0].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw & 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first))


@dataclass
class TextIndex:
    """An index in a folder. key names the rows, text is what is searched."""

    spark: SparkSession
    folder: str
    key: str
    text: str

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str = "id", text: str = "content") -> TextIndex:
        """Writes both tables. Null texts are never found, texts of fewer than three characters have no trigrams but are
        kept for short needles; repeated keys are rows each; other columns are kept; no rows make an empty index."""
        spark = rows.sparkSession
        names = [*rows.columns, "_block", "_at"]

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, block, at, size = TaskContext.get().partitionId(), 0, 0, 0
            for batch in batches:
                blocks, places = [], []
                for n in pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist():
                    if size and size + n > BLOCK:
                        block, at, size = block + 1, 0, 0
                    blocks.append(part << 32 | block)
                    places.append(at)
                    at, size = at + 1, size + n
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], names)

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_block long", "_at long"])
        numbered = rows.mapInArrow(number, schema).withColumn("_part", F.shiftright("_block", 32))
        numbered.write.partitionBy("_part").option("compression", "zstd").option("parquet.block.size", str(BLOCK)).parquet(f"{folder}/texts")
        spark.createDataFrame([(f"{schema}, _part long",)], "value string").coalesce(1).write.text(f"{folder}/schema")
        made = cls(spark, folder, key, text)
        made._index()
        return made

    def texts(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.text(f"{self.folder}/schema").first()[0]).parquet(f"{self.folder}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram long, block long, n long, places binary, bucket int").parquet(f"{self.folder}/postings")

    def _index(self) -> None:
        low = self.texts().select("_block", "_at", F.lower(self.text).alias("low")).filter("low is not null")

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, str]]] = {}
            for batch in batches:  # a file of one block is read by one task or more, so a block may have several rows a trigram
                for block, at, t in zip(*(batch.column(c).to_pylist() for c in ("_block", "_at", "low")), strict=True):
                    if block not in held:
                        for b in list(held):
                            yield rows_of(b, held.pop(b))
                    held.setdefault(block, []).append((at, t))
            for b in list(held):
                yield rows_of(b, held.pop(b))

        def rows_of(block: int, found: list[tuple[int, str]]) -> pa.RecordBatch:
            found.sort(key=lambda x: x[0])
            grams, row = trigram_rows([t for _, t in found])
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
            data, ends = packed_lists(np.array([a for a, _ in found], np.int64)[row], first)
            lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(grams[first]), pa.array(np.full(len(first), block)), pa.array(np.diff(np.append(first, len(grams)))), lists], ["gram", "block", "n", "places"])

        rows = low.mapInArrow(post, "gram long, block long, n long, places binary").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        spread = F.when(F.col("n") > FREQUENT, F.pmod(F.xxhash64("block"), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
        dealt = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", spread).sortWithinPartitions("bucket", "gram", "block")
        dealt.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#gram", "true").option("parquet.bloom.filter.max.bytes", str(BLOOM)).option("compression", "zstd").parquet(f"{self.folder}/postings")

    def candidates(self, needle: str) -> DataFrame | None:
        """(_block, _at) of rows that have the rarest trigrams of a needle; None if some trigram is nowhere."""
        spark = self.spark
        low = spark.range(1).select(F.lower(F.lit(needle))).first()[0]
        grams = trigrams(low).tolist()
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram long").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        mine = self.postings().filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        often = {r[0]: r[1] for r in mine.groupBy("gram").agg(F.sum("n")).collect()}  # a row a trigram of the needle
        if len(often) < len(grams):
            return None
        rare = sorted(grams, key=lambda g: (often[g], g))[:RAREST]
        # a block's few lists meet in one row
        lists = mine.filter(F.col("gram").isin(rare)).groupBy("block").agg(F.collect_list(F.struct("gram", "places")).alias("lists")).filter(F.size(F.array_distinct(F.col("lists.gram"))) == len(rare))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, found in zip(batch.column("block").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                    by_gram: dict[int, list[np.ndarray]] = {}
                    for x in found:
                        by_gram.setdefault(x["gram"], []).append(unpacked(x["places"]))
                    at = reduce(np.intersect1d, (np.concatenate(x) for x in by_gram.values()))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at)], ["_block", "_at"])

        return lists.mapInArrow(meet, "_block long, _at long")

    def search(self, needle: str) -> DataFrame:
        """Rows whose text has the needle, in any case, with all their columns: as `contains` on lower-cased texts. Needles of
        fewer than three characters scan the texts; an empty one is in every text."""
        low = F.lower(self.text)
        has = F.contains(low, F.lower(F.lit(needle)))
        texts = self.texts()
        if len(self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]) < 3:
            return texts.filter(has).drop(*OWN)
        found = self.candidates(needle)
        if found is None:
            return texts.limit(0).drop(*OWN)
        found = stored(found)
        blocks = found.select("_block").distinct().limit(NAMED_BLOCKS + 1).collect()
        if len(blocks) <= NAMED_BLOCKS:
            named = [r[0] for r in blocks]
            texts = texts.filter(F.col("_part").isin(sorted({b >> 32 for b in named})) & F.col("_block").isin(named)) if blocks else texts.limit(0)
        return texts.join(found, ["_block", "_at"], "left_semi").filter(has).drop(*OWN)
