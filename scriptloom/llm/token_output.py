"""Token-id files coded by an adaptive context-mixing range coder.

Documents, in order, are encoded by a tokenizer and written in blocks of whole documents. A block is reset and
checksummed on its own. Its ids are dealt to lanes of consecutive ids, which numpy codes side by side, one id of each
lane in a step. What the lanes have seen so far predicts the next ids: orders 2 and 1 (a table each of the id that
followed this context, with a confidence) and order 0 (counts, renewed every few steps). The three are mixed by how
often each confidence has held in this block; the mixture is an interval in [0, 2**28) for each lane's range coder.

A block is: "TIDB", crc32 of what follows (4 bytes), counts of ids, documents, lanes and bytes of the document table
(4 bytes each), the crc32 of the ids, the table (zlib: ids, null flags and lengths of documents), the number of 32-bit
digits of each lane, and the digits, lane by lane.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, slices, stored
from .tokens import encoder

END, BLOCK_IDS, LANES, LANE_IDS = 2, 1 << 21, 4096, 512
VOCABULARY = 1 << 16
#: An interval's unit, the least share of it that order 0 has (so that each id's own share is 1 or more), and how often order 0
#: is renewed after its first steps.
_UNIT = 28
_TOTAL, _LEAST, _RENEW = 1 << _UNIT, 1 << 22, 16
#: Order-0 counts are scaled to add up to 2**22, so that shifts divide by them.
_BITS = 22
_HASH = 18
_U = np.uint64
#: The next confidence (0 to 3) after a miss, then after a hit.
_TRUST = np.array([0, 0, 1, 2, 1, 2, 3, 3], np.int64)


class Mixer:
    """The model of one block; encoder and decoder feed it the same ids and so see the same intervals."""

    def __init__(self, lanes: int):
        #: For each context of order 1 and 2 the id that followed it, times 4, plus a confidence.
        self.table1, self.table2 = np.zeros(VOCABULARY, np.int64), np.zeros(1 << _HASH, np.int64)
        self.seen1, self.seen2 = [], []
        self.held, self.tried = np.full((2, 4), 0.4), np.ones((2, 4))
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)
        self.counts, self.recent, self.steps = np.zeros(VOCABULARY, np.int64), [], 0
        self.renew()
        self.weigh()

    def renew(self) -> None:
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=VOCABULARY)
            self.recent = []
        freq = 1 + self.counts * ((1 << _BITS) - VOCABULARY) // max(1, int(self.counts.sum()))
        freq[0] += (1 << _BITS) - int(freq.sum())
        self.cum = np.append(0, np.cumsum(freq))
        self.narrow = self.cum.astype(np.int32)  # half the memory that a search walks through

    def weigh(self) -> None:
        """The widths of the guesses' intervals, by how often each confidence has held."""
        for k, seen in enumerate((self.seen2, self.seen1)):
            if seen:
                n = np.bincount(np.concatenate(seen), minlength=8).reshape(2, 4)
                self.held[k] += n[1]
                self.tried[k] += n[0] + n[1]
                seen.clear()
        share = self.held / self.tried
        self.wide2 = (share[0] * (_TOTAL - 2 * _LEAST)).astype(np.int64)
        self.wide1 = (share[1][:, None] * (_TOTAL - _LEAST - self.wide2)).astype(np.int64).reshape(-1)

    def predict(self) -> None:
        """Order-2 and order-1 guesses of the lanes' next ids, and their intervals."""
        self.at2 = (self.one * 40503 + self.two * 61681 + (self.two >> 3)) & ((1 << _HASH) - 1)
        self.p2, self.p1 = self.table2[self.at2], self.table1[self.one]
        self.c2, self.c1 = self.p2 & 3, self.p1 & 3
        self.guess2, self.guess1 = self.p2 >> 2, self.p1 >> 2
        self.a2 = self.wide2[self.c2]
        self.a1 = self.wide1[(self.c1 << 2) | self.c2] * (self.guess1 != self.guess2)
        self.a12 = self.a2 + self.a1
        self.rest = _TOTAL - self.a12

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.rest * self.cum[ids] >> _BITS
        size = (self.rest * self.cum[ids + 1] >> _BITS) - start
        start += self.a12
        self.hit2, self.hit1 = self.guess2 == ids, self.guess1 == ids
        one = np.flatnonzero(self.hit1 & (self.a1 > 0))
        start[one], size[one] = self.a2[one], self.a1[one]
        two = np.flatnonzero(self.hit2 & (self.a2 > 0))
        start[two], size[two] = 0, self.a2[two]
        return start.astype(_U), size.astype(_U)

    def symbol(self, point: np.ndarray) -> np.ndarray:
        out = np.where(point < self.a2, self.guess2, self.guess1)
        far = np.flatnonzero(point >= self.a12)
        # below 2**50 over 2**28, so the double quotient is floored rightly
        target = ((((point[far] - self.a12[far] + 1) << _BITS) - 1) / self.rest[far]).astype(np.int32)
        out[far] = np.searchsorted(self.narrow, target, side="right") - 1
        return out

    def learn(self, ids: np.ndarray) -> None:
        """After interval(ids), which tells the hits."""
        for hit, p, c, table, at, seen in ((self.hit2, self.p2, self.c2, self.table2, self.at2, self.seen2), (self.hit1, self.p1, self.c1, self.table1, self.one, self.seen1)):
            state = c + 4 * hit
            seen.append(state)
            table[at] = np.where(c > 0, p - c, ids << 2) + _TRUST[state]
        self.two, self.one = self.one, ids
        self.recent.append(ids)
        self.steps += 1
        if self.steps <= _RENEW or len(self.recent) == _RENEW:  # the first steps have everything to learn
            self.renew()
        if self.steps <= _RENEW or len(self.seen1) == 4:
            self.weigh()


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-n // LANE_IDS)))
    return lanes, -(-n // lanes)


def encode_ids(ids: np.ndarray) -> tuple[int, bytes]:
    if len(ids) and int(ids.max()) >= VOCABULARY:
        raise ValueError(f"ids must be less than {VOCABULARY}")
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    mixer = Mixer(lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    digits = np.zeros((steps + 3, lanes), np.int64)
    used = np.zeros(lanes, np.int64)
    every = np.arange(lanes)

    def carry(which: np.ndarray) -> None:
        digits[used[which] - 1, which] += 1

    for t in range(steps):
        now = grid[t]
        mixer.predict()
        start, size = mixer.interval(now)
        unit = width >> _U(_UNIT)
        more = low + unit * start
        if (over := more < low).any():
            carry(every[over])
        low, width = more, unit * size
        if (short := width < _U(1 << 32)).any():
            k = every[short]
            digits[used[k], k] = (low[k] >> _U(32)).astype(np.int64)
            used[k] += 1
            low[k] <<= _U(32)
            width[k] <<= _U(32)
        mixer.learn(now)
    for _ in range(2):
        digits[used, every] = (low >> _U(32)).astype(np.int64)
        used += 1
        low <<= _U(32)
    for k in range(len(digits) - 1, 0, -1):  # carries that reached a full digit go on to the one before
        full = digits[k] >> 32
        digits[k] &= 0xFFFFFFFF
        digits[k - 1] += full
    by_lane = digits.astype("<u4").T
    kept = np.arange(len(digits)) < used[:, None]
    return lanes, used.astype("<u4").tobytes() + by_lane[kept].tobytes()


def decode_ids(n: int, lanes: int, data: bytes) -> np.ndarray:
    steps = -(-n // lanes)
    used = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    flat = np.frombuffer(data, "<u4", offset=4 * lanes).astype(_U)
    at, ends = np.cumsum(used) - used, np.cumsum(used)
    flat = np.append(flat, np.zeros(2, _U))
    code = flat[at] << _U(32) | flat[at + 1]
    at = at + 2
    mixer = Mixer(lanes)
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    out, every = np.zeros((steps, lanes), np.int64), np.arange(lanes)
    for t in range(steps):
        mixer.predict()
        unit = width >> _U(_UNIT)
        now = mixer.symbol(np.minimum(code // unit, _U(_TOTAL - 1)).astype(np.int64))
        start, size = mixer.interval(now)
        code, width = code - unit * start, unit * size
        if (short := width < _U(1 << 32)).any():
            k = every[short]
            digit = np.where(at[k] < ends[k], flat[np.minimum(at[k], len(flat) - 1)], _U(0))
            code[k] = code[k] << _U(32) | digit
            at[k] += 1
            width[k] <<= _U(32)
        mixer.learn(now)
        out[t] = now
    return out.T.reshape(-1)[:n]


def to_block(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    table = zlib.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes() + np.array(lengths, "<u4").tobytes())
    lanes, coded = encode_ids(ids)
    body = struct.pack("<IIIII", len(ids), len(docs), lanes, len(table), zlib.crc32(ids.astype("<u4").tobytes())) + table + coded
    return b"TIDB" + struct.pack("<I", zlib.crc32(body)) + body


def from_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their lengths, and all ids of a block; ValueError if it is damaged."""
    if block[:4] != b"TIDB" or struct.unpack_from("<I", block, 4)[0] != zlib.crc32(block[8:]):
        raise ValueError("damaged block")
    n, docs, lanes, size, crc = struct.unpack_from("<IIIII", block, 8)
    table = zlib.decompress(block[28 : 28 + size])
    keys, null = np.frombuffer(table, "<i8", docs), np.frombuffer(table, np.uint8, docs, 8 * docs)
    ids = decode_ids(n, lanes, block[28 + size :]).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the ids don't match their checksum")
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], np.frombuffer(table, "<u4", docs, 9 * docs).astype(np.int64), ids


def write_tokens(docs: DataFrame, *, path: str | None = None, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all documents, in order of the key (then the text; null keys first), in blocks, and returns
    the written table: part, block, first (ids of the part before it), n, data. A null or empty text is the end id alone;
    very long texts are encoded whole, in one block. Repeated rows are written each; extra columns are ignored; no rows
    give no blocks. Ids of 65,536 and more are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number, first = encoder(path or public_tokenizers.path("word_bpe_49k.json")), TaskContext.get().partitionId(), 0, 0
        held, lengths, keys, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            data = to_block(keys, lengths, np.concatenate(held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "block": pa.array([number], pa.int64()), "first": pa.array([first], pa.int64()), "n": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in slices(batches, "text", 8 << 20):
            ids, n = encode.with_end(batch.column("text"), end)
            rows, names, ends = 0, batch.column("doc_id").to_pylist(), np.cumsum(n)
            while rows < len(n):  # whole documents up to the one that fills the block
                done = int(ends[rows - 1]) if rows else 0
                to = min(len(n), int(np.searchsorted(ends, done + BLOCK_IDS - size)) + 1)
                held.append(ids[done : ends[to - 1]])
                lengths += n[rows:to].tolist()
                keys += names[rows:to]
                size, rows = size + len(held[-1]), to
                if size >= BLOCK_IDS:
                    yield block()
                    number, first, held, lengths, keys, size = number + 1, first + size, [], [], [], 0
        if held:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(run, "part long, block long, first long, n long, data binary"))


def read_tokens(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """From written blocks, for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the
    ids as little-endian uint32) and, unless told not to, the ids. Rows come as they were written: repeated ones each, null
    keys first; no blocks give no rows; a damaged block is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", 1):
            docs, lengths, ids = from_block(batch.column("data")[0].as_py())
            ends = np.cumsum(lengths)
            data = ids.tobytes()
            own = [data[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(docs, pa.int64()), pa.array(batch.column("at")[0].as_py() + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())] if with_ids else columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4])

    totals = blocks.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("ahead"))  # one row for each written part
    return blocks.join(F.broadcast(ahead), "part").select((F.col("ahead") + F.col("first")).alias("at"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
