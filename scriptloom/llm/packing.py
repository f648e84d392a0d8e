"""Packing by concatenating and cutting: all documents, in order, are one line of ids that is cut every `length` ids.

Two passes. The first puts documents in order into partitions, encodes each and writes its ids with its place in the
partition, so the partitions' totals are sums over written rows; a prefix sum over the totals (one row a partition)
gives each partition's global offset. The second cuts each document where its global places cross a multiple of the
length; a document that crosses leaves a piece on either side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, slices, stored
from .tokens import as_binary, encoder

LENGTH, END = 2048, 1
_ENCODED = "part long, place long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_in_order(docs: DataFrame, path: str, end: int, order: list[Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its partition, its place there (ids before it), n ids with the end id, and the ids as
    uint32 bytes. Partitions are ranges of the order; equal keys go by the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 4 << 20):
            ids, n = encode.with_end(batch.column("text"), end)
            starts = place + np.cumsum(n) - n
            place += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(starts), batch.column("doc_id"), pa.array(n), as_binary(ids, n)], ["part", "place", "doc_id", "n", "ids"])

    rows = docs.select(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    by = [*[f"o{k}" for k in range(len(order))], "doc_id", "text"]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *by[:-1], F.xxhash64("text")).sortWithinPartitions(*by).select("doc_id", "text")
    return stored(dealt.mapInArrow(run, _ENCODED))


def global_offsets(coded: DataFrame) -> DataFrame:
    """part and ahead: the ids in all partitions before it. One row a partition goes through one task."""
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    return totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("ahead"))


def pack(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end: int = END, order: list[Column] | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and, unless told not to, ids
    (uint32 bytes).

    Documents go by `order` (the key alone if not given; null keys first). A null or empty text is the end id alone.
    Very long texts are encoded whole, in one task. All sequences but the last are full; the last is shorter. Repeated rows are packed once each. Extra columns are
    ignored; no rows give no rows.
    """
    coded = encode_in_order(docs, path or public_tokenizers.path("byte_bpe_50k.json"), end, order or [], key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 8 << 20):
            rows = []
            for doc, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                start = 0
                while start < n:
                    offset = (at + start) % length
                    m = min(n - start, length - offset)
                    piece = ids[4 * start : 4 * (start + m)]
                    rows.append((doc, start, m, zlib.crc32(piece), n, (at + start) // length, offset, piece)[: 8 if with_ids else 7])
                    start += m
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 8 if with_ids else 7]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    ahead = F.broadcast(global_offsets(coded))  # one row for each partition
    return coded.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("place")).alias("at"), "n", "ids").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)
