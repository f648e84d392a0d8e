"""How filters interact: what each of five filters removes, for every order in which they may be applied.

A counting Bloom sketch of all texts clears those that are certainly unique: tasks count the places of their texts'
hashes, counts are merged slice by slice, and a text one of whose places was counted once has no copy. Only possible
repeats are shuffled whole, for the exact smallest id of each text. Each document then is five bits, its failed filters;
documents are counted by part and bits, and all orders and steps follow from these counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, stored

FILTERS = "ABCDE"
#: Places a text is counted at, and counters a text gets (as a power of two follows, up to twice as many).
PLACES, PER_TEXT = 3, 16
#: Most counters (two bits each, so 64 MB are sent to the tasks at most), and counters of a slice.
MOST_BITS, SLICE_BITS = 28, 20
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(128, 192))
_ODD = b"#$%&*|"


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    x = hashes.astype(np.int64).view(np.uint64)
    return [(mixed(x, 71 + k) >> np.uint64(64 - bits)).astype(np.int64) for k in range(PLACES)]


def sketch(hashes: DataFrame, bits: int) -> np.ndarray:
    """Counters (0, 1, or 2 for more) of all places of one column of longs, four to a byte.

    A task sends the places that its texts touch, so what is shuffled follows the texts, not tasks times counters; a
    slice of counters is put together in one task. At most 64 MB come to the driver, by MOST_BITS.
    """
    inner = min(bits, SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            # a text counts a place once, also where two of its own places fall together
            per_text = np.sort(np.stack(places(h, bits)), axis=0)
            fresh = np.ones(per_text.shape, bool)
            fresh[1:] = per_text[1:] != per_text[:-1]
            at, n = np.unique(per_text[fresh], return_counts=True)
            which = at >> inner
            cuts = np.flatnonzero(np.append(True, which[1:] != which[:-1])).tolist() + [len(at)] if len(at) else [0]
            code = ((at & ((1 << inner) - 1)) << 1 | (n > 1)).astype("<u4")
            yield pa.RecordBatch.from_pydict({"slice": pa.array(which[cuts[:-1]]), "data": pa.array([code[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data"), strict=True):
                table = mine.setdefault(k, np.zeros(1 << inner, np.uint8))
                code = np.frombuffer(data.as_py(), "<u4")
                at = code >> 1
                table[at] = np.minimum(2, table[at] + 1 + (code & 1).astype(np.uint8))  # a place stands once in a message
        for k, table in mine.items():
            t = table.reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "data": pa.array([(t[:, 0] | t[:, 1] << 2 | t[:, 2] << 4 | t[:, 3] << 6).tobytes()], pa.binary())})

    sent = hashes.mapInArrow(count, "slice long, data binary").repartition(max(1, 1 << bits - inner), "slice").mapInArrow(merge, "slice long, data binary")
    whole = np.zeros((1 << bits) // 4, np.uint8)
    for r in sent.toLocalIterator():
        at = r["slice"] << inner - 2
        whole[at : at + (1 << inner - 2)] = np.frombuffer(bytes(r["data"]), np.uint8)
    return whole


def may_repeat(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """False for hashes that certainly stand once."""
    bits, hit = (len(table) * 4).bit_length() - 1, np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        hit &= table[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3 > 1
    return hit


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at spaces and \\t to \\r, no others
    n = len(words)
    points = len(text.translate(None, _INNER))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * upper > 10 * points) << 2 | (len(text.translate(None, _ODD)) < len(text)) << 3


def masks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each document: doc_id, part, mask (bit k: fails filter k of ABCDE).

    A null text counts as empty, a null part as the empty string. A document fails E if a smaller id has the same text;
    a row with a null id fails it never and fails no other, and rows that repeat the smallest id don't fail it. Very
    long texts are taken whole. Extra columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.cast("binary").alias("text"), F.xxhash64(body).alias("h"))
    n = base.count()
    bits = min(MOST_BITS, max(12, (PER_TEXT * n - 1).bit_length()))
    sent = spark.sparkContext.broadcast(sketch(base.select("h"), bits))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            again = may_repeat(batch.column("h").to_numpy(zero_copy_only=False), sent.value)
            mask = [failures(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(again), batch.column("name")], ["doc_id", "part", "mask", "again", "name"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            again = pa.array(may_repeat(batch.column("h").to_numpy(zero_copy_only=False), sent.value))
            yield batch.select(["doc_id", "text"]).filter(again)

    flagged = stored(base.withColumn("name", F.sha2("text", 256)).mapInArrow(flag, "doc_id long, part string, mask int, again boolean, name string"))
    # whole texts are compared; the name only leads the result back to the rows
    first = base.select("doc_id", "text", "h").filter("doc_id is not null").mapInArrow(repeats, "doc_id long, text binary").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = first.select("doc_id", F.sha2("text", 256).alias("name"), F.lit(0).alias("stays"))
    clear = flagged.filter("doc_id is null or not again").select("doc_id", "part", "mask")
    # one row a text, met by its own id: copies that make up a third of the table don't meet in one task
    other = flagged.filter("doc_id is not null and again").join(first.distinct(), ["doc_id", "name"], "left")
    return clear.union(other.select("doc_id", "part", (F.col("mask") + F.coalesce("stays", F.lit(16))).alias("mask")))


def mask_counts(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """By part and mask: n documents, and how many of them are good (quality 1) and toxic (toxic 1) in labels. An id that
    labels repeat has what any of its rows has; labels without an id are ignored."""
    kinds = labels.filter(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    kinds = kinds.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    per_id = masked.filter("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(kinds, "doc_id", "left")
    keyless = masked.filter("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = per_id.select("part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    rows = rows.union(keyless.select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, from at
    most 32 counts a part."""
    orders = F.array(*[F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(c)) for c in p]).alias("bits")) for p in itertools.permutations(FILTERS)])
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(orders).alias("o")).select("part", "masks", "o.filter_order", F.posexplode("o.bits").alias("k", "bit"), "o.bits")
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("k")), F.lit(0), lambda a, b: a + b))

    def total(field: str, holds) -> F.Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda t, m: t + F.when(holds(m["mask"]), m[field]).otherwise(0))

    mine, bit, before = (lambda m: m.bitwiseAND(bit) != 0), F.col("bit"), F.col("before")
    here = lambda m: mine(m) & (m.bitwiseAND(before) == 0)
    rows = rows.select(
        "part",
        "filter_order",
        (F.col("k") + 1).alias("step"),
        "bit",
        total("n", lambda m: m.bitwiseAND(before + bit) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: mine(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "bit"]).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The whole audit: 600 rows a part, zeros included; no documents give no rows."""
    return interactions(stored(mask_counts(masks(docs, key=key, text=text, part=part), labels, key)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (
    SELECT part, doc_id,
        (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, FALSE)::INT AS mask
    FROM w
),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
r AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
