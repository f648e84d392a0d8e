"""Anchors: places in texts chosen by their own content, so that equal windows have equal anchors.

The anchor of a window is its least-hashed k-gram (the first of equals). Every repeated window then shows as a repeated
anchor, and only about two in (window - k + 2) places are anchors. Tasks send anchors in packed arrays, a row for each
bucket of hashes; a hash that many texts of one task share is known to repeat, so it goes straight to the result and
only two of its places are sent on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, mixed, partitions

#: A hash with more places than this in one task is a known repeat there.
SENT_PLACES = 8
_PLACE_BITS = 24


def least_in_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` neighbouring hashes the place of the least (the first of equals, by 40 bits). More hashes
    than places have numbers are taken in stretches that overlap by a run less one, so every run lies in one stretch."""
    stretch = 1 << _PLACE_BITS
    if len(hashes) > stretch:
        return np.concatenate([least_in_windows(hashes[a : a + stretch], width) + a for a in range(0, len(hashes) - width + 1, stretch - width + 1)])
    low = (mixed(hashes, 40) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def pack(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(hash, owner, place) arrays of a task as rows (deal, hash, owner, place); known repeats have deal < 0."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, owner, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = (mixed(h, 41) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((owner, h, bucket))
        h, owner, place, bucket = h[by], owner[by], place[by], bucket[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h)))
        owners = np.add.reduceat(np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])).astype(np.int64), first)
        often = np.repeat((n > SENT_PLACES) & (owners > 1), n)
        known = np.where(often, -1 - bucket, 0)
        keep = ~often
        at = first[(n > SENT_PLACES) & (owners > 1)]
        keep[at] = True
        keep[(first + n - 1)[(n > SENT_PLACES) & (owners > 1)]] = True
        deal = np.concatenate([bucket[keep], known[often]])
        h, owner, place = (np.concatenate([x[keep], x[often]]) for x in (h, owner, place))
        cuts = np.flatnonzero(np.append(True, deal[1:] != deal[:-1])).tolist() + [len(deal)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.RecordBatch.from_pydict({"deal": pa.array(deal[cuts[:-1]])} | {name: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for name, x in (("hash", h), ("owner", owner), ("place", place.astype(np.int32)))})

    total = 0
    for x in found:
        if len(x[0]):
            held.append(x)
            total += len(x[0])
        if total > 2_000_000:
            yield flush()
            total = 0
    if held:
        yield flush()


def repeated(docs: DataFrame, find: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], *, within: bool, hot: int | None = None) -> DataFrame:
    """(owner, places): the places of anchors that repeat; in one owner too if `within`. places: int32 arrays as bytes.

    With `hot` there is a third column, null in these rows, and rows with that column alone: the hashes that have more
    than so many places in one bucket and the numbers of places, int64 pairs as bytes. A hash is in two buckets at most
    (of known repeats and of others), so one that is never told has 2 * hot places at most."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    schema = "owner long, places binary" + ("" if hot is None else ", hot binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(find(batches), buckets)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["deal"]):
            h, owner, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hash", np.uint64), ("owner", np.int64), ("place", np.int32)))
            if table.column("deal")[0].as_py() >= 0:
                by = np.lexsort((place, owner, h))
                h, owner, place = h[by], owner[by], place[by]
                other = np.append(True, h[1:] != h[:-1])
                first = np.flatnonzero(other)
                step = np.append(True, (owner[1:] != owner[:-1]) | ((place[1:] != place[:-1]) if within else False))
                step[first] = False
                many = np.add.reduceat(step.astype(np.int64), first) > 0
                keep = np.repeat(many, np.diff(np.append(first, len(h))))
                h, owner, place = h[keep], owner[keep], place[keep]
            if hot is not None:
                often, n = np.unique(h, return_counts=True)
                if (n > hot).any():
                    told = np.stack([often[n > hot].view(np.int64), n[n > hot]], axis=1)
                    yield pa.RecordBatch.from_pydict({"owner": pa.array([None], pa.int64()), "places": pa.array([None], pa.binary()), "hot": pa.array([told.tobytes()], pa.binary())})
            by = np.lexsort((place, owner))
            owner, place = owner[by], place[by]
            cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist() + [len(owner)] if len(owner) else []
            if cuts:
                rest = {} if hot is None else {"hot": pa.nulls(len(cuts) - 1, pa.binary())}
                yield pa.RecordBatch.from_pydict({"owner": pa.array(owner[cuts[:-1]]), "places": pa.array([place[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())} | rest)

    sent = docs.mapInArrow(send, "deal long, hash binary, owner binary, place binary")
    return sent.repartition(partitions(spark), "deal").sortWithinPartitions("deal").mapInArrow(receive, schema)


def by_owner(places: DataFrame) -> DataFrame:
    return places.groupBy("owner").agg(F.collect_list("places").alias("places"))


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(rows), np.int32)).astype(np.int64)


def collapsed(keys: list[np.ndarray], owner: np.ndarray, place: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, list[bytes], ...]:
    """Occurrences that agree in all keys as one: the number of the first of each, and the owners (int64), places (int32)
    and more (int64) of all, as bytes. What one task has seen many times is sent once."""
    by = np.lexsort((place, owner, *keys))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        x = k[by]
        new[1:] |= x[1:] != x[:-1]
    cuts = np.flatnonzero(new).tolist() + [len(by)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    values = [owner[by].astype(np.int64), place[by].astype(np.int32), *(x[by].astype(np.int64) for x in more)]
    return by[cuts[:-1]], *([x[a:b].tobytes() for a, b in spans] for x in values)
