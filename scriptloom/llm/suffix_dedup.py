"""Removal of byte strings that stand more than once, by hash-compared suffix sorting.

A window is `width` bytes of one document. A repeated window has a repeated anchor (its k-gram of least hash), so only the
surroundings of repeated anchors are looked at. Around one anchor's occurrences, the texts to the right and the
reversed texts to the left are sorted: prefix polynomial hashes and binary search find how far two of them agree, so a
comparison takes a logarithmic number of steps in the mergesort. The agreement of neighbours in the sorted order is
verified on the bytes; if a hash has misled, the group is sorted again by its bytes. A window that begins `o` bytes
before the anchor is repeated if another occurrence agrees on o bytes to the left and width - o to the right.

Documents with equal texts are one class: if they are as long as a window they go whole, and one text of each class
stands for them where other documents are judged. A class's id is verified by 64 more bits; were two texts to share an
id, ids are made anew with another salt.

The same sorted orders also tell the bytes in shorter repeats, which are reported and not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import BYTE_VALUES, bloom_of, groups, mixed, partitions, powers, prefix_hashes, slices, span_hashes, stored, texts

WIDTH = 400
#: Bytes of the shorter repeats that are counted (n_repeated) and not removed.
REPORTED = 256
#: Bytes of contexts that are sorted at once; a group is never split.
SORT_BYTES = 4 << 20


def text_ids(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> np.ndarray:
    """For each row's bytes a 64-bit id and 64 more bits that verify it (a row of two for each)."""
    raw, salt = memoryview(data.tobytes()), salt.to_bytes(8, "little")
    made = [hashlib.blake2b(raw[a:b], digest_size=16, salt=salt).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def find_anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places (of all windows that lie in one row), their hashes and rows."""
    gram = width // 2
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = prefix_hashes(BYTE_VALUES[data])
    start = np.arange(len(data) - gram + 1)
    h = span_hashes(p, start, start + gram)
    least = anchors.least_in_windows(h, width - gram + 1)
    good = np.zeros(len(least), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        good[a : max(a, b - width + 1)] = True
    at = np.unique(least[good])
    return at, mixed(h[at], 51), np.searchsorted(offsets, at, side="right") - 1


class Strings:
    """Strings in one byte array, compared by prefix hashes and binary search."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        # powers begin anew with each string: only beginnings are compared, so no inverse is needed
        power = powers(int(self.size.max(initial=0)))[0]
        self.prefix = np.zeros(len(self.data), np.uint64)
        for lo in range(0, len(strings), 1024):
            a, z = int(self.start[lo]), int(self.end[min(lo + 1024, len(strings)) - 1])
            place = np.arange(a, z) - np.repeat(self.start[lo : lo + 1024], self.size[lo : lo + 1024])
            np.cumsum(BYTE_VALUES[self.data[a:z]] * power[place], dtype=np.uint64, out=self.prefix[a + 1 : z + 1])
            self.prefix[a + 1 : z + 1] += self.prefix[a]

    def agreement(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common beginning of strings i and j."""
        a, b = self.start[i], self.start[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.prefix[a + mid] - self.prefix[a] == self.prefix[b + mid] - self.prefix[b]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j."""
        n = self.agreement(i, j)
        ends_i, ends_j = n == self.size[i], n == self.size[j]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + n, last)], self.data[np.minimum(self.start[j] + n, last)]
        return np.where(ends_i | ends_j, self.size[i] < self.size[j], x < y)

    def sorted_in(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of the strings inside each group (groups are runs of equal numbers); all runs merge side by side."""
        order = np.arange(len(group))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        base, length = np.repeat(first, size), np.repeat(size, size)
        place, run = np.arange(len(group)) - base, 1
        while run < size.max(initial=0):
            mine = np.flatnonzero(length > run)
            pair = place[mine] // (2 * run) * (2 * run)
            left = place[mine] - pair < run
            other = np.where(left, pair + run, pair)
            n = np.clip(length[mine] - other, 0, run)
            lo, hi = np.zeros(len(mine), np.int64), n.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                theirs = order[base[mine[open_]] + other[open_] + mid]
                me = order[mine[open_]]
                # equal strings of the left run stay first
                ahead = np.where(left[open_], self.before(theirs, me), ~self.before(me, theirs))
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
            to = base[mine] + pair + np.where(left, place[mine] - pair, place[mine] - pair - run) + lo
            merged = order.copy()
            merged[to] = order[mine]
            order, run = merged, 2 * run
        return order

    def neighbours(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order and each string's agreement with the one before it (-1 at a group's first), verified."""
        order = self.sorted_in(group)
        agree = np.full(len(order), -1)
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        a, b = order[inner - 1], order[inner]
        n = self.agreement(a, b)
        agree[inner] = n
        misled: set[int] = set()
        for lo in range(0, len(n), 1024):
            m, x, y = n[lo : lo + 1024], a[lo : lo + 1024], b[lo : lo + 1024]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wrong = self.data[np.repeat(self.start[x], m) + step] != self.data[np.repeat(self.start[y], m) + step]
            misled |= set(group[inner[lo : lo + 1024]][np.repeat(np.arange(len(m)), m)[wrong]].tolist())
        last = len(self.data) - 1
        ends_a, ends_b = n == self.size[a], n == self.size[b]
        turned = np.where(ends_a | ends_b, self.size[a] > self.size[b], self.data[np.minimum(self.start[a] + n, last)] > self.data[np.minimum(self.start[b] + n, last)])
        misled |= set(group[inner[turned]].tolist())
        for g in misled:
            at = np.flatnonzero(group == g)
            own = {k: self.data[self.start[k] : self.end[k]].tobytes() for k in at.tolist()}
            order[at] = sorted(own, key=own.get)
            for k in at[1:].tolist():
                x, y = own[order[k - 1]], own[order[k]]
                agree[k] = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return order, agree


def repeated_spans(right: Strings, left: Strings, group: np.ndarray, width: int, most: int, ranks: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the least and largest `o` of its repeated windows (largest -1 if none). ranks: the neighbours of
    right and left, where they are known."""
    low, high = np.full(len(group), most + 1), np.full(len(group), -1)
    (by_right, agree_right), (by_left, agree_left) = ranks or (right.neighbours(group), left.neighbours(group))
    size = np.bincount(group)[group]
    two = np.flatnonzero(np.append(False, group[1:] == group[:-1]) & (size == 2))
    lo, hi = width - agree_right[two], np.minimum(agree_left[two], most)
    lo = np.maximum(lo, 0)
    good = lo <= hi
    for k in (two[good], two[good] - 1):
        low[k], high[k] = lo[good], hi[good]
    many = size > 2
    if not many.any():
        return low, high
    near_right, near_left = (np.where(np.append(x[1:] >= 0, False), np.append(x[1:], -1), -1) for x in (agree_right, agree_left))
    best = np.maximum(agree_right, near_right)
    reach = np.zeros(len(group), np.int64)
    reach[by_right] = best
    reach_left = np.zeros(len(group), np.int64)
    reach_left[by_left] = np.maximum(agree_left, near_left)
    might = many & (reach + np.minimum(reach_left, most) >= width)
    might = np.isin(group, np.unique(group[might])) & many
    mine = np.flatnonzero(might)
    if not len(mine):
        return low, high
    pick_right, pick_left = might[by_right], might[by_left]
    r_order, r_agree = by_right[pick_right], agree_right[pick_right]
    l_order, l_agree = by_left[pick_left], agree_left[pick_left]
    at = np.zeros(len(group), np.int64)
    at[mine] = np.arange(len(mine))
    rank_r, rank_l = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
    # the clusters change only where an agreement ends
    turns = np.unique(np.concatenate([[0, most], np.clip(l_agree, 0, most), np.clip(l_agree + 1, 0, most), np.clip(width - r_agree, 0, most), np.clip(width - r_agree - 1, 0, most)]))
    for o in turns.tolist():
        rank_r[at[r_order]] = np.cumsum(r_agree < width - o)
        rank_l[at[l_order]] = np.cumsum(l_agree < o)
        ok = (right.size[mine] >= width - o) & (left.size[mine] >= o)
        both = rank_r * (len(mine) + 1) + rank_l
        _, inverse, n = np.unique(both[ok], return_inverse=True, return_counts=True)
        twice = mine[ok][n[inverse] > 1]
        low[twice], high[twice] = np.minimum(low[twice], o), np.maximum(high[twice], o)
    return low, high


def bounds(spans: list[bytes] | None) -> list[tuple[int, int]]:
    """The union of spans (int32 pairs as bytes), as runs in order; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in np.unique(np.frombuffer(b"".join(spans or []), np.int32).reshape(-1, 2), axis=0).tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, *, width: int = WIDTH, reported: int | None = None, key: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (the bytes that strings of `reported` bytes
    cover which also start elsewhere; those shorter than `width` stay in the text) and, unless told not to, kept (the
    bytes left).

    Null counts as empty; texts shorter than a window keep all. Rows that repeat a text (whatever their keys) are
    repeats of each other. A null key is a document too; its text is looked up by its content. Very long texts are read
    whole. Extra columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    reported = min(width, REPORTED) if reported is None else reported
    if not 0 < reported <= width:
        raise ValueError("reported must be between 1 and width")
    gram = reported // 2
    most = width - gram
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = texts(batch.column("text"))
            ids = text_ids(data, offsets, salt)[:, 0]
            at, h, row = find_anchors(data, offsets, reported)
            fresh = np.zeros(len(ids), bool)
            for k, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[k] = True
            use = fresh[row]
            yield h[use], ids[row[use]], (at - offsets[row])[use]

    def classed(salt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                ids = text_ids(*texts(batch.column("text")), salt)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["class", "check"])

        rows = base.select("text").mapInArrow(run, "class long, check long")
        return stored(rows.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("check").alias("least"), F.max("check").alias("most")).filter("copies > 1"))

    salt = 0
    while not (classes := classed(salt)).filter("least <> most").isEmpty():  # two texts have one id: other ids
        salt += 1
    copied = classes.select("class")
    places = stored(anchors.repeated(base, find, within=True))
    maybe, twins = bloom_of(places.select("owner").distinct()), bloom_of(copied)

    def with_class(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                data, offsets = texts(batch.column("text"))
                ids = text_ids(data, offsets, salt)[:, 0]
                hit = test(ids)
                if hit is not None:
                    batch, ids = batch.filter(pa.array(hit)), ids[hit]
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(ids)], ["doc_id", "text", "class"])

        return base.mapInArrow(run, "doc_id long, text string, class long")

    texts_once = with_class(lambda ids: maybe(ids) if maybe else None).dropDuplicates(["class"])
    chosen = texts_once.join(anchors.by_owner(places), F.col("class") == F.col("owner")).drop("owner")

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = texts(batch.column("text"))
            raw = data.tobytes()
            p = prefix_hashes(BYTE_VALUES[data])
            rows, at = [], []
            for k, x in enumerate(batch.column("places").to_pylist()):
                mine = anchors.unpacked(x) + offsets[k]
                rows.append(np.full(len(mine), k))
                at.append(mine)
            row, at = np.concatenate(rows), np.concatenate(at)
            lo, hi = np.maximum(at - most, offsets[row]), np.minimum(at + width, offsets[row + 1])
            h = mixed(span_hashes(p, at, at + gram), 51).view(np.int64)
            contexts = pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).dictionary_encode()
            ids = batch.column("class").to_numpy()
            one, owners, places = anchors.collapsed([h, (at - lo), contexts.indices.to_numpy()], ids[row], at - offsets[row])
            yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array((at - lo)[one].astype(np.int32)), contexts.dictionary.take(contexts.indices.take(pa.array(one))), pa.array(owners, pa.binary()), pa.array(places, pa.binary())], ["anchor", "left", "context", "owners", "places"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.concat_tables(held)
            anchor = table.column("anchor").to_numpy()
            group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
            left = table.column("left").to_pylist()
            # occurrences with equal surroundings are sorted once
            same: dict[tuple, int] = {}
            kind = np.array([same.setdefault(x, len(same)) for x in zip(group.tolist(), left, table.column("context").to_pylist(), strict=True)], np.int64)
            right, left_of = Strings([c[n:] for _, n, c in same]), Strings([c[:n][::-1] for _, n, c in same])
            of = np.array([g for g, _, _ in same], np.int64)
            ranks = right.neighbours(of), left_of.neighbours(of)
            owners = table.column("owners").to_pylist()
            times = np.array([len(x) // 8 for x in owners])
            copied = np.bincount(kind, times) > 1
            kind = np.repeat(kind, times)
            owner, place = np.frombuffer(b"".join(owners), np.int64), np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32)
            columns = {}
            for name, wide in (("places", width), ("near", reported)):
                low, high = repeated_spans(right, left_of, of, wide, wide - gram, ranks)
                span_low, span_high = np.maximum(0, wide - right.size), np.minimum(left_of.size, wide - gram)
                copies = copied & (span_low <= span_high)
                low[copies], high[copies] = span_low[copies], span_high[copies]
                hit = high[kind] >= 0
                span = np.stack([place - high[kind], place - low[kind] + wide], axis=1).astype(np.int32)
                columns[name] = (hit, span)
            some = columns["near"][0] | columns["places"][0]
            by = np.flatnonzero(some)[np.argsort(owner[some], kind="stable")]
            cuts = np.flatnonzero(np.append(True, owner[by][1:] != owner[by][:-1])).tolist() + [len(by)] if len(by) else [0]
            spans = list(zip(cuts, cuts[1:], strict=False))
            return pa.RecordBatch.from_pydict({"owner": pa.array(owner[by][cuts[:-1]], pa.int64())} | {name: pa.array([span[by[a:b]][hit[by[a:b]]].tobytes() for a, b in spans], pa.binary()) for name, (hit, span) in columns.items()})

        for table in groups(batches, ["anchor"]):
            if table.num_rows > 1 or len(table.column("owners")[0].as_py()) > 8:
                held.append(table)
                size += table.nbytes
            if size > SORT_BYTES:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    dealt = chosen.mapInArrow(surround, "anchor long, left int, context binary, owners binary, places binary").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    marked = stored(dealt.mapInArrow(sort, "owner long, places binary, near binary"))
    touched = bloom_of(marked.select("owner").distinct())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for t, x, near, twin in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("places", "near", "twin")), strict=True):
                t = t or b""
                runs = [(0, len(t))] if twin and len(t) >= width else bounds(x)
                part = [(0, len(t))] if twin and len(t) >= reported else bounds(near)
                left = b"".join(t[a:b] for (_, a), (b, _) in zip([(0, 0), *runs], [*runs, (len(t), len(t))], strict=True)) if runs else t
                out.append((len(t), len(t) - len(left), len(runs), hashlib.sha256(left).hexdigest(), sum(b - a for a, b in part), left)[: len(kinds)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"][: 7 if with_kept else 6]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names) - 1]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long" + ", kept binary" * with_kept
    twin = F.col("twin").isNotNull()
    rows = marked.groupBy("owner").agg(F.collect_list("places").alias("places"), F.collect_list("near").alias("near")).withColumnRenamed("owner", "class").join(copied.withColumn("twin", F.lit(True)), "class", "full")
    if touched is None or twins is None:
        return with_class(lambda ids: None).join(rows, "class", "left").select("doc_id", "text", "places", "near", twin.alias("twin")).mapInArrow(finish, schema)
    inside = with_class(lambda ids: touched(ids) | twins(ids)).join(rows, "class", "left").select("doc_id", "text", "places", "near", twin.alias("twin"))
    outside = with_class(lambda ids: ~(touched(ids) | twins(ids))).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("places"), F.lit(None).cast("array<binary>").alias("near"), F.lit(False).alias("twin"))
    return inside.mapInArrow(finish, schema).union(outside.mapInArrow(finish, schema))
