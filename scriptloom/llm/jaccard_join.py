"""N-gram Jaccard join by prefix filtering under several global orders.

A document's set is its distinct word n-grams. Two sets with Jaccard similarity t or more share a token among the first
n - ceil(t * n) + 1 of each, whatever the global order of tokens. Three orders are used: frequency levels from a fixed-size
count of all tokens (two hash rows), rare first, with different orders inside a level. A pair is a candidate only if it
shares a prefix token under every order.

Documents with equal sets are one class from the start. A token that few classes have in their prefix gives their
pairs (a bounded number for each); one that many have (a family of near copies) only ties them to the least of them.
The first order is joined over all classes, the others only over classes that got a pair from it, which are few.
What survives all orders, with these ties, falls into clusters, and every cluster is verified on its whole sets by
tasks: a class is compared with others until all are known to be connected or not. Clusters beyond a bound are
compared block against block, so no task holds more than two blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, bloom_of, components, groups, mixed, partitions, slices, stored, summed_slices, texts, word_hashes, words_of

ORDERS = 3
#: Hash cells of the frequency count; two rows of them, 8 MB in all as sent. The size doesn't follow the input: what matters
#: is which tokens a large share of documents has.
CELL_BITS = 21
CELLS = 1 << CELL_BITS
#: A prefix token of more classes than this ties them together without pairs.
PAIRS_UP_TO = 128
#: Classes of a cluster that one task compares; larger clusters are cut into blocks of half as many.
BLOCK = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def token_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (uint64) of each text; with fewer words the whole sequence; none without words."""
    data, offsets = texts(column)
    data = _LOWER[data]
    start, end, first = words_of(data, offsets, _SPACE)
    words = word_hashes(data, start, end)
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(0x9DDFEA08EB382D69) + words[k : len(words) - n + 1 + k], k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mixed(whole * np.uint64(0x9DDFEA08EB382D69) + words[k : k + 1], 100 + b - a)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Class ids that stand for several sets; about three in 10**10 sets. More than this are an error.
MOST_CLASHES = 100_000


def set_ids(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of the whole sorted set: its class id, and another that verifies it."""
    x = np.concatenate([tokens, np.array([len(tokens)], np.uint64)])
    at = np.arange(len(x), dtype=np.uint64)
    return tuple(int(mixed(np.bitwise_xor.reduce(mixed(x + at, k), keepdims=True) + np.add.reduce(mixed(x, k + 1), keepdims=True), k + 2).view(np.int64)[0]) for k in (5, 55))


def set_id(tokens: np.ndarray, clashes: frozenset[int] = frozenset(), identify: Callable = set_ids) -> int:
    """The class id; the other hash where several sets have the first."""
    first, other = identify(tokens)
    return other if first in clashes else first


def cells(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64), (mixed(tokens, 9) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """2 x CELLS levels (a quarter of log2 of the documents that have a token of the cell), over all documents."""
    parts = 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, CELLS), np.int32)
        for batch in slices(batches, "text", 1 << 20):
            sets = token_sets(batch.column("text"), n)
            for row, cell in zip(table, cells(np.concatenate(sets)), strict=True):
                at, times = np.unique(cell, return_counts=True)
                row[at] += times.astype(np.int32)
        if table.any():
            flat = np.split(table.reshape(-1), parts)
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(parts), pa.int64()), "salt": pa.array([salt] * parts, pa.int64()), "data": pa.array([x.tobytes() for x in flat], pa.binary())})

    found = summed_slices(docs.select("text").mapInArrow(count, "slice long, salt long, data binary"), kind=np.int32)
    if not found:
        return np.zeros((2, CELLS), np.uint8)
    total = np.concatenate([found[k] for k in range(parts)]).reshape(2, CELLS)
    return (4 * np.log2(total + 1.0)).astype(np.uint8)


def needed(size: np.ndarray | int, per_cent: int):
    """Least size of an intersection, and of the other set: ceil(t * size)."""
    return -(-per_cent * size // 100)


def prefixes(tokens: np.ndarray, levels: np.ndarray, per_cent: int, orders: Sequence[int] = range(ORDERS)) -> list[np.ndarray]:
    """The prefix of a set under each of the orders."""
    size = len(tokens) - needed(len(tokens), per_cent) + 1
    one, two = cells(tokens)
    a, b = levels[0][one], levels[1][two]
    out = []
    for k in orders:
        level = (np.minimum(a, b), b, a)[k]
        rank = level.astype(np.uint64) << np.uint64(56) | mixed(tokens, 20 + k) >> np.uint64(8)
        out.append(tokens[np.argpartition(rank, size - 1)[:size]] if size < len(tokens) else tokens)
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the upper bytes, which are alike, stand together and so are compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def postings(docs: DataFrame, levels: np.ndarray, n: int, per_cent: int, buckets: int, name: Callable[[np.ndarray], int] = set_id, orders: Sequence[int] = range(ORDERS), test: Callable | None = None) -> DataFrame:
    """For each of the orders and bucket of tokens: arrays of (token, class, size), once for each class and task; only of rows whose
    keys pass the test, if there is one."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total = set(), [[] for _ in orders], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for order, rows in zip(orders, held, strict=True):
                if rows:
                    token = np.concatenate([r[0] for r in rows])
                    owner = np.repeat(np.array([r[1] for r in rows], np.int64), [len(r[0]) for r in rows])
                    size = np.repeat(np.array([r[2] for r in rows], np.int32), [len(r[0]) for r in rows])
                    bucket = (mixed(token, 30 + order) % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    token, owner, size, bucket = token[by], owner[by], size[by], bucket[by]
                    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)]
                    spans = list(zip(cuts, cuts[1:], strict=False))
                    yield pa.RecordBatch.from_pydict({
                        "deal": pa.array([order * buckets + int(bucket[a]) for a, _ in spans], pa.int64()),
                        "token": pa.array([token[a:b].tobytes() for a, b in spans], pa.binary()), "owner": pa.array([owner[a:b].tobytes() for a, b in spans], pa.binary()), "size": pa.array([planes(size[a:b]) for a, b in spans], pa.binary()),
                    })
                rows.clear()

        for batch in slices(batches, "text", 1 << 20):
            if test is not None:
                batch = having_keys(batch, test)
            for tokens in token_sets(batch.column("text"), n):
                if len(tokens) and (owner := name(tokens)) not in seen:
                    seen.add(owner)
                    for rows, p in zip(held, prefixes(tokens, sent.value, per_cent, orders), strict=True):
                        rows.append((p, owner, len(tokens)))
                        total += len(p)
            if total > 1_000_000:
                yield from flush()
                total = 0
        yield from flush()

    return docs.select(*(["doc_id"] if test else []), "text").mapInArrow(run, "deal long, token binary, owner binary, size binary")


def having_keys(batch: pa.RecordBatch, test: Callable) -> pa.RecordBatch:
    """The rows whose doc_id passes the test; without a key they are known by NULL_KEY."""
    return batch.filter(pa.array(test(batch.column("doc_id").fill_null(NULL_KEY).to_numpy(zero_copy_only=False))))


def near_pairs(dealt: DataFrame, per_cent: int, buckets: int) -> DataFrame:
    """From postings: (order, a, b): pairs of classes that share a prefix token, or, with order -1, ties of a family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["deal"]):
            order = table.column("deal")[0].as_py() // buckets
            token, owner = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("token", np.uint64), ("owner", np.int64)))
            size = np.concatenate([from_planes(x, np.int32) for x in table.column("size").to_pylist()])
            by = np.lexsort((owner, size, token))
            token, owner, size = token[by], owner[by], size[by].astype(np.int64)
            new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
            token, owner, size = token[new], owner[new], size[new]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(first, len(token)))
            run_of = np.repeat(np.arange(len(first)), length)
            place = np.arange(len(token)) - first[run_of]
            small = length[run_of] <= PAIRS_UP_TO
            found = []
            for step in range(1, PAIRS_UP_TO):
                left = np.flatnonzero(small & (place + step < length[run_of]))
                if not len(left):
                    break
                left = left[needed(size[left + step], per_cent) <= size[left]]  # sizes ascend within a run
                found.append((owner[left], owner[left + step]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(pairs.shape[1], order), pa.int32()), "a": pa.array(pairs[0]), "b": pa.array(pairs[1])})
            hot = np.flatnonzero(~small & (place > 0))
            if len(hot):
                ties = np.unique(np.stack([owner[first[run_of[hot]]], owner[hot]]), axis=1)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(ties.shape[1], -1), pa.int32()), "a": pa.array(ties[0]), "b": pa.array(ties[1])})

    return dealt.repartition(partitions(dealt.sparkSession), "deal").sortWithinPartitions("deal").mapInArrow(run, "kind int, a long, b long")


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def connect(sets: list[np.ndarray], levels: np.ndarray, per_cent: int) -> list[int]:
    """For each set the number of the first set that links reach from it. A set is compared with all that share a prefix
    token with it under every order and can be large enough; sets of the largest component so far needn't be."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [0, 0 if 100 * both >= per_cent * (size[0] + size[1] - both) else 1]
    union = Union(m)
    owner, flat = np.repeat(np.arange(m), size), np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    lists = []
    for k in range(ORDERS):
        p = [prefixes(x, levels, per_cent, (k,))[0] for x in sets]
        t, o = np.concatenate(p), np.repeat(np.arange(m), [len(x) for x in p])
        s = np.argsort(t, kind="stable")
        lists.append((p, t[s], o[s]))
    flat, owner = flat[by], owner[by]

    def having(tokens: np.ndarray, at: np.ndarray, who: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(at, tokens, "left"), np.searchsorted(at, tokens, "right")
        n = hi - lo
        return who[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    done, pivot = np.zeros(m, bool), 0
    while pivot is not None:
        done[pivot] = True
        near = (needed(size, per_cent) <= size[pivot]) & (needed(size[pivot], per_cent) <= size)
        for p, t, o in lists:
            shares = np.zeros(m, bool)
            shares[having(p[pivot], t, o)] = True
            near &= shares
        near[pivot] = False
        if near.any():
            both = np.bincount(having(sets[pivot], flat, owner), minlength=m)
            for other in np.flatnonzero(near & (100 * both >= per_cent * (size + size[pivot] - both))).tolist():
                union.join(pivot, other)
        roots = np.array([union.root(x) for x in range(m)]) if m < 64 or near.any() or pivot == 0 else roots
        largest = np.bincount(roots).argmax()
        rest = np.flatnonzero(~done & (roots != largest))
        pivot = int(rest[0]) if len(rest) else None
    return [union.root(x) for x in range(m)]


def linked_classes(base: DataFrame, *, words: int, per_cent: int, identify: Callable = set_ids) -> tuple[DataFrame, DataFrame]:
    """base has doc_id, text and columns that are carried. Returns its rows as doc_id, carried columns, n_shingles and class
    (null without tokens), and each class's smallest key (rep, null if it has none) and root: the smallest class that links
    reach, its own included. Classes are vertices, so keys may be null or repeat."""
    spark = base.sparkSession
    buckets = partitions(spark)
    levels = frequency_levels(base, words)
    sent = spark.sparkContext.broadcast(levels)
    carried = [f for f in base.schema if f.name not in ("doc_id", "text")]
    names = [f.name for f in carried]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = token_sets(batch.column("text"), words)
            one, two = zip(*(identify(x) if len(x) else (None, None) for x in sets), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: batch.column(c) for c in names} | {"n_shingles": pa.array([len(x) for x in sets], pa.int64()), "class": pa.array(one, pa.int64()), "check": pa.array(two, pa.int64())})

    told = stored(base.mapInArrow(tell, ", ".join(["doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in carried), "n_shingles long", "class long", "check long"])))
    classes = stored(told.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), (F.min("check") < F.max("check")).alias("clash")))
    found = classes.filter("clash").select("class").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise RuntimeError("too many sets share a class id")
    clashes = frozenset(r[0] for r in found)
    if clashes:
        told = told.withColumn("class", F.when(F.col("class").isin(list(clashes)), F.col("check")).otherwise(F.col("class")))
        classes = stored(told.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep")))
    told, classes, name = told.drop("check"), classes.select("class", "rep"), functools.partial(set_id, clashes=clashes, identify=identify)
    # rep says which row brings the set of a class; any row without a key may
    filled = F.coalesce("rep", F.lit(NULL_KEY).cast("long")).alias("rep")

    def pairs_of(orders: Sequence[int], test: Callable | None = None) -> DataFrame:
        return stored(near_pairs(postings(base, levels, words, per_cent, buckets, name, orders, test), per_cent, buckets))

    first = pairs_of((0,))
    paired = first.filter("kind = 0").select(F.explode(F.array("a", "b")).alias("class")).distinct()
    pairs = first.union(pairs_of(range(1, ORDERS), bloom_of(stored(paired.join(classes, "class").select(filled)))))
    survive = pairs.filter("kind >= 0").groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("orders")).filter(F.col("orders") == (1 << ORDERS) - 1).select("a", "b")
    clusters = stored(components(survive.union(pairs.filter("kind < 0").select("a", "b"))).withColumnRenamed("id", "class").join(classes, "class").select("class", filled, "root"))
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    test = bloom_of(clusters.select("rep"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "text", 1 << 20):
            if test is not None:
                batch = having_keys(batch, test)
            out = []
            for rep, tokens in zip(batch.column("doc_id").fill_null(NULL_KEY).to_pylist(), token_sets(batch.column("text"), words), strict=True):
                if len(tokens) and (one := (name(tokens), rep)) not in seen:
                    seen.add(one)
                    out.append((*one, tokens.tobytes()))
            if out:
                yield pa.RecordBatch.from_pydict({name: pa.array(list(c), t) for name, c, t in zip(("class", "rep", "tokens"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    blocks = F.ceil(F.col("members") * 2 / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    sets = base.select("doc_id", "text").mapInArrow(fetch, "class long, rep long, tokens binary").join(clusters.join(sizes, "root"), ["class", "rep"]).withColumn("blocks", F.when(F.col("members") <= BLOCK, 1).otherwise(blocks))
    spread = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", "class", "tokens", (F.col("blocks") > 1).alias("cut"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["root", "i", "j"]):
            ids = table.column("class").to_numpy()
            by = np.unique(ids, return_index=True)[1]
            data = table.column("tokens").to_pylist()
            if len(by) > 1:
                roots = connect([np.frombuffer(data[k], np.uint64) for k in by.tolist()], sent.value, per_cent)
                linked = [(int(ids[by[k]]), int(ids[by[r]])) for k, r in enumerate(roots) if r != k]
                if linked:
                    a, b = zip(*linked, strict=True)
                    yield pa.RecordBatch.from_pydict({"class": pa.array(a, pa.int64()), "root": pa.array(b, pa.int64()), "cut": pa.array([table.column("cut")[0].as_py()] * len(a))})

    links = stored(spread.repartition(buckets, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(verify, "class long, root long, cut boolean"))
    joined = components(links.filter("cut").select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("class"), "root")
    roots = links.filter("not cut").select("class", "root").union(joined)
    return told, classes.join(roots, "class", "left").select("class", "rep", F.coalesce("root", "class").alias("root"))


def jaccard_join(docs: DataFrame, *, words: int = 3, per_cent: int = 90, key: str = "doc_id", text: str = "text", identify: Callable = set_ids) -> DataFrame:
    """For each document: doc_id, n_shingles, and component_id: the smallest doc_id that links reach, its own included.

    Two documents link when their sets' Jaccard similarity is per_cent / 100 or more; no link between different sets is
    lost. Null, empty and wordless texts have no tokens and link with nothing. Rows that repeat a key are reported each,
    by their own texts' links. A row with a null key links as others do; it gets its component's smallest key, null if
    there is none. Very long texts are taken whole. Extra columns are ignored; no rows give no rows. Sets are identified
    by 64-bit hashes of n-grams (words of over 128 bytes by blake2b) and 128 bits of whole sets.
    """
    told, ids = linked_classes(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), words=words, per_cent=per_cent, identify=identify)
    least = ids.groupBy("root").agg(F.min("rep").alias("component"))
    return told.join(ids.join(least, "root").select("class", "component"), "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
