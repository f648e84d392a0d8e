"""Language identification by multilingual mixture inference.

Learning counts hashed byte trigrams for each language over all labelled texts (counted in tasks, summed by Spark). For
a document, expectation-maximisation finds the proportions of all languages under which its trigrams are likeliest.
Languages are then taken in order of their proportions as long as each raises the likelihood by more than its penalty;
the prediction is the largest of that set, its score the proportion over all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import slices, texts

BUCKETS, ROUNDS = 1 << 15, 8
#: A further language must raise the log-likelihood by this many times log(trigrams): overlapping trigrams aren't independent.
PENALTY = 6.0
UNKNOWN = "und"

#: Bytes outside letters count as a space.
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def trigrams(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte trigram with a letter in its middle, and its row."""
    data, offsets = texts(lowered)
    x = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    edge = row[1:] != row[:-1]  # next to a text's ends stand spaces, not its neighbours in the batch
    before, after = np.full_like(x, 32), np.full_like(x, 32)
    before[1:], after[:-1] = np.where(edge, 32, x[:-1]), np.where(edge, 32, x[1:])
    bucket = ((before << np.uint32(16) | x << np.uint32(8) | after) * np.uint32(2654435761)) >> np.uint32(17)
    use = x != 32
    return bucket[use].astype(np.int64), row[use]


def lowered(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([(t or "").lower() for t in batch.column("text").to_pylist()], pa.large_string())


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> list[Row]:
    """Trigram counts (lang, bucket, n) of all rows with a text and a language; at most 32,768 rows a language are returned
    to the driver. Rows with a null text or language teach nothing; repeated rows count each; no rows give no counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 2 << 20):
            bucket, row = trigrams(lowered(batch))
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in set(names):
                mine = bucket[(names == name)[row]]
                found[name] = found.get(name, 0) + np.bincount(mine, minlength=BUCKETS)
        for name, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()


def model(counts: list[Row]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probability of each bucket for each (buckets x languages)."""
    langs = sorted({r.lang for r in counts})
    n = np.zeros((BUCKETS, len(langs)))
    at = {name: k for k, name in enumerate(langs)}
    for r in counts:
        n[r.bucket, at[r.lang]] = r.n
    if langs:
        n += 0.5
        n /= n.sum(axis=0)
    return langs, n.astype(np.float32)


def proportions(n: np.ndarray, p: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: n trigrams with likelihoods p (rows x languages), documents begin at `first`; allowed: documents x languages.
    Returns proportions and log-likelihoods."""
    sizes = np.diff(np.append(first, len(n)))
    doc = np.repeat(np.arange(len(first)), sizes)
    total = np.add.reduceat(n, first, dtype=np.float64)[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        r = p * share.astype(np.float32)[doc]
        r *= (n / r.sum(axis=1))[:, None]
        share = np.add.reduceat(r, first, axis=0, dtype=np.float64) / total
    likely = np.log((p * share.astype(np.float32)[doc]).sum(axis=1) + np.float32(1e-30))
    return share, np.add.reduceat(n * likely, first, dtype=np.float64)


def infer(lower: pa.Array, langs: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: whether it has trigrams, its language's number, its score, and how many languages its set has."""
    rows = len(lower)
    best, score, size = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows, np.int64)
    bucket, row = trigrams(lower)
    if not len(bucket) or not langs:
        return np.zeros(rows, bool), best, score, size
    key = np.sort(row * BUCKETS + bucket)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(start, len(key))).astype(np.float32)
    doc, likely = key[start] // BUCKETS, p[key[start] % BUCKETS]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    known = doc[first]
    share, whole = proportions(n, likely, first, np.ones((len(first), len(langs))))
    order = np.argsort(-share, axis=1, kind="stable")
    cost = PENALTY * np.log(np.add.reduceat(n, first) + 1)
    each = np.add.reduceat(n[:, None] * np.log(likely), first, axis=0, dtype=np.float64)
    top = order[:, 0].copy()
    before = each[np.arange(len(first)), top]
    single = each.argmax(axis=1)
    took = np.ones(len(first), np.int64)
    open_ = whole - before > cost  # no set can gain more than that of all languages
    ends = np.append(first[1:], len(n))
    for k in range(2, len(langs) + 1):
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        pick = np.concatenate([np.arange(first[d], ends[d]) for d in todo])
        at = np.cumsum([0, *(ends[todo] - first[todo])[:-1]])
        allowed = np.zeros((len(todo), len(langs)))
        np.put_along_axis(allowed, order[todo, :k], 1.0, axis=1)
        now, value = proportions(n[pick], likely[pick], at, allowed)
        gain = value - before[todo] > cost[todo]
        win = todo[gain]
        before[win], took[win], top[win] = value[gain], k, now[gain].argmax(axis=1)
        open_[todo[~gain]] = False
        open_[win] &= whole[win] - before[win] > cost[win]
    top = np.where(took == 1, single, top)
    best[known], size[known] = top, took
    score[known] = np.clip(np.round(share[np.arange(len(first)), top], 5), 0, 1)
    has = np.zeros(rows, bool)
    has[known] = True
    return has, best, score, size


def identify(docs: DataFrame, counts: list[Row], *, keep: list[str], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "n_langs")) -> DataFrame:
    """docs' columns `keep` with lang_pred, score and n_langs (languages in the selected set), or as `names` calls them.

    `und` with score 0 where the text is null, has no letters, or nothing has been learnt. Text is all that a prediction
    reads; equal texts and repeated rows get equal predictions (scores have five decimals), and ties go to the first language by name. Whole texts
    are read, however long. No rows give no rows. A kept column with one of the new names is an error; others may have any name.
    """
    if clash := set(keep) & set(names):
        raise ValueError(f"columns of the results' names: {sorted(clash)}")
    langs, p = model(counts)
    kinds = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            low = lowered(batch)
            letters = np.array([next((True for c in t if c.isalpha()), False) for t in low.to_pylist()], bool)
            has, best, score, size = infer(low, langs, p)
            has &= letters
            found = [langs[b] if h else UNKNOWN for h, b in zip(has, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, size, 0).astype(np.int32))], [*keep, *names])

    columns = [F.col(c) for c in keep] + ([] if "text" in keep and text == "text" else [F.col(text).alias("text")])
    return docs.select(*columns).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the key as text leaves 1 when divided by 3; a null key isn't in it."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
