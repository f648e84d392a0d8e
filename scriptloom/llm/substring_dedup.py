"""Substring deduplication by repeated-phrase automata.

A window is `width` consecutive words of one document. Windows that may recur are found by their anchors (word 4-grams
of least hash that several documents have). Their surroundings, short fragments, are dealt by anchor to shards; a shard
confirms which of its windows are in several documents, compiles these into an Aho-Corasick automaton (words as
characters), and streams all its fragments through it to locate every occurrence. An occurrence is removed if a
document with a smaller key has the window too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import bloom_of, groups, mixed, partitions, prefix_hashes, slices, span_hashes, stored, texts, word_hashes, words_of

WIDTH, GRAM = 13, 4
#: Fragments that one automaton is compiled for, about. An anchor with more has its windows dealt one by one, by their words.
SHARD_FRAGMENTS = 8_000
#: Different words that one character each can stand for; in a shard with more, a word is two characters.
CHARACTERS = 1_100_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def gram_hashes(words: np.ndarray) -> np.ndarray:
    total = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        total = mixed(total * np.uint64(0x9DDFEA08EB382D69) + words[k : len(words) - GRAM + 1 + k], k)
    return total


def window_anchors(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one row, the place of each one's anchor, and the hashes of the 4-grams."""
    h = gram_hashes(words)
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    at = anchors.least_in_windows(h, width - GRAM + 1)
    row_end = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(len(at)) + width <= row_end[: len(at)])
    return start, at[start], h


def substring_dedup(docs: DataFrame, *, width: int = WIDTH, key: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 and, unless told not to, kept_text (kept words joined by one space).

    Null, empty and wordless texts have no words and keep the empty text. A row with a null
    key keeps all, and no other row is judged by it. Rows that repeat a key, with one text or with several, don't judge
    each other, as none has a smaller key; each is judged by the smaller keys and reported. Windows are judged on the
    input. Very long texts are taken whole. Extra columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    # a row is known by its key and text (row), and judged by its key
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("row"))
    keyed = base.filter("doc_id is not null")

    def parsed(column: pa.Array):
        data, offsets = texts(column)
        start, end, first = words_of(data, offsets, _SPACE)
        return data, start, end, first, word_hashes(data, start, end)

    def find(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            _, _, _, first, words = parsed(batch.column("text"))
            _, at, h = window_anchors(words, first, width)
            at = np.unique(at)
            row = np.searchsorted(first, at, side="right") - 1
            yield h[at], batch.column("row").to_numpy(zero_copy_only=False)[row], at - first[row]

    found = stored(anchors.repeated(keyed, find, within=False, hot=SHARD_FRAGMENTS))
    places = found.filter("hot is null").select("owner", "places")
    told = np.frombuffer(b"".join(bytes(r["hot"]) for r in found.filter("hot is not null").select("hot").collect()), np.int64).reshape(-1, 2)
    hot = spark.sparkContext.broadcast(np.unique(told[:, 0].view(np.uint64)))
    hot_shards = max(1, int(told[:, 1].sum()) * (width - GRAM + 1) // SHARD_FRAGMENTS)
    maybe = bloom_of(places.select("owner").distinct())

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if maybe is not None:
                batch = batch.filter(pa.array(maybe(batch.column("row").to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                yield batch

    chosen = keyed.mapInArrow(some, "doc_id long, text string, row long").join(anchors.by_owner(places), F.col("row") == F.col("owner")).drop("owner")
    per_shard = max(1, int(places.agg(F.sum(F.length("places"))).first()[0] or 0) // 4 // SHARD_FRAGMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, start, end, first, words = parsed(batch.column("text"))
            windows, at, h = window_anchors(words, first, width)
            wanted = np.zeros(len(words) + 1, bool)
            for row, x in enumerate(batch.column("places").to_pylist()):
                here = first[row] + anchors.unpacked(x)
                wanted[here[here < first[row + 1]]] = True
            hit = wanted[at]
            windows, at = windows[hit], at[hit]
            if not len(windows):
                continue
            alone = np.isin(h[at], hot.value)
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)) | alone)
            lo, hi, a = windows[new], windows[np.append(new[1:], len(windows)) - 1] + width, at[new]
            row = np.searchsorted(first, lo, side="right") - 1
            raw = data.tobytes()
            frags = [raw[s:e] for s, e in zip(start[lo].tolist(), end[hi - 1].tolist(), strict=True)]
            frags = pa.array(frags, pa.binary()).dictionary_encode()
            owner, judged = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("row", "doc_id"))
            one, owners, places, keys = anchors.collapsed([h[a].view(np.int64), frags.indices.to_numpy()], owner, lo - first[row], judged)
            deal = (mixed(h[a[one]], 42) % np.uint64(per_shard)).astype(np.int64)
            by_words = alone[new][one]
            if by_words.any():  # equal windows meet wherever they stand
                begin = lo[one][by_words]
                deal[by_words] = -1 - (mixed(span_hashes(prefix_hashes(words), begin, begin + width), 43) % np.uint64(hot_shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(deal), frags.dictionary.take(frags.indices.take(pa.array(one))), *(pa.array(x, pa.binary()) for x in (owners, places, keys))], ["deal", "frag", "owners", "places", "keys"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["deal"]):
            owners = table.column("owners").to_pylist()
            owner, judged = (np.frombuffer(b"".join(x), np.int64) for x in (owners, table.column("keys").to_pylist()))
            place = np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32)
            of = np.repeat(np.arange(len(owners)), [len(x) // 8 for x in owners])
            where, starts = occurrences(table.column("frag").combine_chunks(), of, judged, width)
            if len(where):
                got, of_key, at = owner[where], judged[where], place[where] + starts
                by = np.lexsort((at, of_key, got))
                got, of_key, at = got[by], of_key[by], at[by]
                cuts = np.flatnonzero(np.append(True, (got[1:] != got[:-1]) | (of_key[1:] != of_key[:-1]))).tolist() + [len(got)]
                yield pa.RecordBatch.from_pydict({"owner": pa.array(got[cuts[:-1]]), "key": pa.array(of_key[cuts[:-1]]), "places": pa.array([at[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    shards = chosen.mapInArrow(cut, "deal long, frag binary, owners binary, places binary, keys binary").repartition(partitions(spark), "deal").sortWithinPartitions("deal")
    marked = stored(shards.mapInArrow(locate, "owner long, key long, places binary"))
    hit = bloom_of(marked.select("owner").distinct())

    def known(batches: Iterator[pa.RecordBatch], of: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = hit(batch.column("row").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(mine if of else ~mine))
            if batch.num_rows:
                yield batch

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, start, end, first, _ = parsed(batch.column("text"))
            gone = np.zeros(len(start) + 1, np.int64)
            for row, x in enumerate(batch.column("places").to_pylist()):
                if x:
                    at = first[row] + anchors.unpacked(x)
                    gone[at] += 1
                    gone[at + width] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            raw, out = data.tobytes(), []
            words = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                mine = keep[a:b]
                left = b" ".join(words[a:b] if mine.all() else [words[a + k] for k in np.flatnonzero(mine).tolist()])
                out.append((b - a, b - a - int(mine.sum()), hashlib.sha256(left).hexdigest(), *([left.decode()] if with_kept else [])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_kept else 4]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names) - 1]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_kept
    rows = marked.groupBy("owner", "key").agg(F.collect_list("places").alias("places"))
    mine = (F.col("row") == F.col("owner")) & (F.col("doc_id") == F.col("key"))
    if hit is None:
        return base.join(rows, mine, "left").drop("owner", "key").mapInArrow(finish, schema)
    columns = "doc_id long, text string, row long"
    inside = base.mapInArrow(lambda b: known(b, True), columns).join(rows, mine, "left").drop("owner", "key")
    outside = base.mapInArrow(lambda b: known(b, False), columns).withColumn("places", F.lit(None).cast("array<binary>"))
    return inside.mapInArrow(finish, schema).union(outside.mapInArrow(finish, schema))


def occurrences(frags: pa.Array, of: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence k is of fragment of[k], in a document of key owner[k]. Returns the numbers of occurrences and the word offsets of
    the windows in them that a smaller owner has too."""
    import ahocorasick

    frags = frags.dictionary_encode()
    data, offsets = texts(frags.dictionary)
    of = frags.indices.to_numpy()[of]
    start, end, first = words_of(data, offsets, _SPACE)
    distinct, code = np.unique(word_hashes(data, start, end), return_inverse=True)
    each = 1
    if len(distinct) > CHARACTERS:  # first and second characters differ, so a match begins where a word does
        each, half = 2, CHARACTERS // 2
        code = np.stack([code // half, half + code % half], axis=1).reshape(-1)
    code = code.astype(np.uint32) + 1
    code[code >= 0xD800] += 0x800
    line = code.astype("<u4").tobytes().decode("utf-32-le")
    frag = [line[a:b] for a, b in zip((each * first[:-1]).tolist(), (each * first[1:]).tolist(), strict=True)]
    span = each * width
    by = np.argsort(owner, kind="stable")  # owners ascend: the first to bring a fragment or window is its least
    same: dict[str, int] = {}
    kind = np.array([same.setdefault(frag[k], len(same)) for k in of[by].tolist()], np.int64)
    sorted_owner = owner[by]
    first_owner, last_owner = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    first_owner[kind[::-1]], last_owner[kind] = sorted_owner[::-1], sorted_owner
    least: dict[str, int] = {}
    several: dict[str, int] = {}
    for x, low, high in zip(same, first_owner.tolist(), last_owner.tolist(), strict=True):
        for i in range(0, len(x) - span + 1, each):
            w = x[i : i + span]
            if least.setdefault(w, low) < high:
                several[w] = least[w]
    if not several:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for w, low in several.items():
        automaton.add_word(w, low)
    automaton.make_automaton()
    del least, several
    found = [(k, (last - span + 1) // each, low) for k, x in enumerate(same) for last, low in automaton.iter(x)]
    which, at, low = (np.array(c, np.int64) for c in zip(*found, strict=True))
    members = np.argsort(kind, kind="stable")  # each fragment's owners, ascending
    start, n = np.searchsorted(kind[members], which), np.bincount(kind, minlength=len(same))[which]
    hit = np.repeat(np.arange(len(which)), n)
    member = members[start[hit] + np.arange(len(hit)) - (np.cumsum(n) - n)[hit]]
    late = sorted_owner[member] > low[hit]
    return by[member[late]], at[hit[late]]
