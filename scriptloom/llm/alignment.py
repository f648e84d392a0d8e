"""Alignment of two tokenizers: which ids of A and B stand for the same bytes, and how often each pair meets.

Byte offsets where a token of A and one of B both end cut a text into groups; in a group of a and b tokens a + b - 1 pairs
overlap. A group of one token each whose B id is the one that has the same bytes as the A id is found by an array from
A ids to B ids, and such links are counted in a vector of the vocabulary's length. Only the links of other groups are
counted by a shuffle of pairs, after each chunk of documents has summed its own. In the second pass a chunk gets back the
counts of its different pairs, each once, and its documents look them up by number.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, partitions, slices, stored, summed_slices, texts
from .tokens import BYTE_CHARACTERS, LONGEST, PieceEncoder

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a chunk, about; a longer document is a chunk of its own.
CHUNK = 2 << 20
#: Pieces of text whose ids a task remembers, for each tokenizer.
REMEMBERED = 250_000
_CODED = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, odd binary, slice long, salt long, data binary, pairs array<long>, times array<long>"
_NAMES = [c.split(" ")[0] for c in _CODED.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
#: Kinds of rows in the coded table: the pairs of a chunk, a document, a task's vector of exact links.
PAIRS, DOCUMENT, VECTOR = 0, 1, 2


class SpacedPieces:
    """Ids of a sentencepiece model for texts that begin with the space it adds, piece by piece.

    No piece of the vocabulary has a space after another character, so a text may be cut before each run of spaces (a
    vocabulary with such pieces gets its texts whole); each different fragment is encoded once."""

    def __init__(self, path: str, remembered: int):
        from sentencepiece import SentencePieceProcessor

        self.model, self.remembered, self.known = SentencePieceProcessor(model_file=path), remembered, {}
        self.cuts = not any("▁" in self.model.id_to_piece(k).lstrip("▁") for k in range(self.model.get_piece_size()))

    def many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int64) of all rows, and the number of each row's; rows are empty or begin with a space."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        first = np.zeros(len(data), bool)
        if self.cuts:
            space = data == 32
            first[1:] = space[1:] & ~space[:-1]
        full = np.diff(offsets) > 0
        first[offsets[1:][full] - 1] = False  # a space alone at the end would be an empty text to the model
        first[offsets[:-1][full]] = True
        at = np.flatnonzero(first)
        ends = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        names, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        found = [self.known.get(p) for p in names]
        new = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(new, self.model.encode([names[k][1:].decode() for k in new], num_threads=1), strict=True):
            found[k] = np.array(ids, "<u4").tobytes()
            if len(names[k]) <= LONGEST:
                self.known[names[k]] = found[k]
        if len(self.known) > self.remembered:
            self.known = {p: x for p, x in zip(names, found, strict=True) if len(p) <= LONGEST}
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begin, n = np.frombuffer(b"".join(found), "<u4").astype(np.int64), np.cumsum(size) - size, size[which]
        total = np.append(0, np.cumsum(n))
        return ids[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])], np.diff(total[np.searchsorted(at, offsets)])


class Aligner:
    """Both tokenizers, the bytes of all their tokens, and same_id: for each A id the B id of the same bytes, or -1."""

    def __init__(self, a_path: str, b_path: str):
        self.a = PieceEncoder(a_path, special_as_text=True, remembered=REMEMBERED)
        self.b = SpacedPieces(b_path, REMEMBERED)
        inverse, model = {c: bytes([b]) for b, c in BYTE_CHARACTERS.items()}, self.b.model
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in json.loads(self.a.tokenizer.to_str())["added_tokens"]}
        a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            a_bytes[k] = token.encode() if token in added else b"".join(map(inverse.__getitem__, token))
        b_bytes, pieces = [], {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
            if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)):
                pieces[b_bytes[k]] = k
        for k, raw in enumerate(b_bytes):  # bytes that no piece has are written by the byte's own token
            if model.is_byte(k):
                pieces.setdefault(raw, k)
        self.same_id = np.array([pieces.get(raw, -1) for raw in a_bytes], np.int64)
        self.same_id[[vocabulary[t] for t in added]] = -1
        #: Ids of A as they are stored.
        self.id_type = "<u2" if len(a_bytes) <= 1 << 16 else "<u4"
        self.tables = [self._table(a_bytes), self._table(b_bytes)]
        most = max(len(a_bytes), len(b_bytes))
        #: An id's decimal digits with what follows it (a comma, a bar or a semicolon), and whole groups of an A id and its same-bytes id.
        self.digits = [str(k).encode() + s for k in range(most) for s in (b",", b"|", b";")]
        self.groups_from = len(self.digits)
        self.digits += [f"{k}|{x};".encode() for k, x in enumerate(self.same_id.tolist())]

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size

    def _joined(self, which: int, ids: np.ndarray) -> np.ndarray:
        data, start, size = self.tables[which]
        n = size[ids]
        return data[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, their number a text, B ids, theirs; none for texts that are null or empty or whose bytes either tokenizer doesn't give back."""
        full = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(column), 0), 0), pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(column, ""), ""), "")
        data, offsets = texts(full)
        a, n_a = self.a.many(full)
        a = a.astype(np.int64)
        b, n_b = self.b.many(data, offsets)
        good = np.ones(len(n_a), bool)
        for which, ids, n in ((0, a, n_a), (1, b, n_b)):
            ends = np.append(0, np.cumsum(self.tables[which][2][ids]))[np.append(0, np.cumsum(n))]
            joined = self._joined(which, ids)
            if np.array_equal(ends, offsets) and np.array_equal(joined, data):
                continue
            good &= np.diff(ends) == np.diff(offsets)
            for r in np.flatnonzero(good).tolist():
                good[r] = np.array_equal(joined[ends[r] : ends[r + 1]], data[offsets[r] : offsets[r + 1]])
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        return a, n_a, b, n_b

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of ids of texts one after the other: the A and B token of each link, whether it is an exact one-to-one group of
        the same-bytes ids, the end of each group in links, and the group of each link."""
        a_ends, b_ends = (np.cumsum(self.tables[k][2][x]) - 1 for k, x in ((0, a), (1, b)))  # each token's last byte
        size = int(a_ends[-1]) + 1 if len(a) else 0
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[a_ends], in_b[b_ends] = True, True
        ends = np.flatnonzero(in_a | in_b)
        in_a, in_b = in_a[ends], in_b[ends]
        common = in_a & in_b
        of_a, of_b, group = (np.cumsum(x) - x for x in (in_a, in_b, common))
        alone = common.copy()
        alone[1:] &= common[:-1]
        return of_a, of_b, alone & (self.same_id[a[of_a]] == b[of_b]), np.flatnonzero(common), group

    def described(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, exact: np.ndarray, last: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `digits` for all groups one after the other, A ids before B ids, and the first place of each group (with the end)."""
        n_groups = len(last)
        plain = np.ones(n_groups, bool)
        plain[group[exact]] = False
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[of_a], group_b[of_b] = group, group
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        size = np.where(plain, in_a + in_b, 1)
        start = np.append(0, np.cumsum(size))
        code = np.empty(start[-1], np.int64)
        code[start[:-1][~plain]] = self.groups_from + a[of_a[exact]]
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        for ids, of, first, before, mark in ((a, group_a, first_a, np.zeros(n_groups, np.int64), 1), (b, group_b, first_b, in_a, 2)):
            k = np.flatnonzero(plain[of])
            g = of[k]
            at_end = np.append(of[1:] != of[:-1], True)[k]
            code[start[g] + before[g] + k - first[g]] = 3 * ids[k] + mark * at_end
        return code, start


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of vocabularies and Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def packed(values: np.ndarray, n: np.ndarray, kind: str) -> pa.Array:
    """Runs of values as bytes of so many unsigned integers."""
    values = np.ascontiguousarray(values, kind)
    ends = np.append(0, np.cumsum(values.itemsize * n)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def table_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def code_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a row for each document (its figures, the A ids of its exact links, the numbers of its other pairs in its
    chunk), one for each chunk (its different other pairs and how often each stands there), and one for each task (its
    vector of exact links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, number = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        vector = np.zeros(len(both.same_id), np.int64)
        for batch in slices(batches, "text", CHUNK):
            chunk, number = part << 32 | number, number + 1
            a, n_a, b, n_b = both.encode(batch.column("text"))
            rows = len(n_a)
            of_a, of_b, exact, last, group = both.align(a, b)
            link_row = np.repeat(np.arange(rows), n_a)[of_a]
            n_links = np.bincount(link_row, minlength=rows)
            n_groups = np.bincount(link_row[last], minlength=rows)
            same = a[of_a[exact]]
            vector += np.bincount(same, minlength=len(vector))
            pairs, odd, times = np.unique(a[of_a[~exact]] << 32 | b[of_b[~exact]], return_inverse=True, return_counts=True)
            code, start = both.described(a, b, of_a, of_b, exact, last, group)
            cuts = start[np.append(0, np.cumsum(n_groups))].tolist()
            strings, hashes = list(map(both.digits.__getitem__, code.tolist())), []
            for lo, hi in itertools.pairwise(cuts):  # the last semicolon goes
                hashes.append(hashlib.sha256(b"".join(strings[lo:hi])[:-1]).hexdigest() if hi > lo else "")
            del strings, code
            n_same = np.bincount(link_row[exact], minlength=rows)
            yield table_of(
                rows,
                kind=pa.array(np.full(rows, DOCUMENT), pa.int32()),
                chunk=pa.array(np.full(rows, chunk)),
                doc_id=batch.column("doc_id"),
                n_a=pa.array(n_a),
                n_b=pa.array(n_b),
                n_groups=pa.array(n_groups),
                n_links=pa.array(n_links),
                groups_sha256=pa.array(hashes, pa.string()),
                same=packed(same, n_same, both.id_type),
                odd=packed(odd, n_links - n_same, "<u4"),
            )
            if len(pairs):
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                yield table_of(1, kind=pa.array([PAIRS], pa.int32()), chunk=pa.array([chunk]), pairs=one(pairs), times=one(times))
        if vector.any():
            yield table_of(1, kind=pa.array([VECTOR], pa.int32()), slice=pa.array([0], pa.int64()), salt=pa.array([part % 64], pa.int64()), data=pa.array([vector.tobytes()], pa.binary()))

    return stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _CODED))


def align(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is encoded from a space and the text, B from the text (it adds the space). Special tokens' strings are plain text.
    Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens: zeros and ''. A link is
    best if its pair's count is the highest of its B id, ties included. Null and repeated keys and repeated rows are
    rows like others, each counted; very long texts are aligned whole; extra columns are ignored; no rows give no rows.
    """
    a_path, b_path = a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY)
    spark = docs.sparkSession
    coded = code_documents(docs, a_path, b_path, key, text)
    own = aligner(a_path, b_path)
    same_id, size_b, id_type = own.same_id, own.b.model.get_piece_size(), own.id_type
    exact = summed_slices(coded.filter(f"kind = {VECTOR}").select("slice", "salt", "data")).get(0, np.zeros(len(same_id), np.int64)).copy()
    wanted = coded.filter(f"kind = {PAIRS}").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    odd = stored(wanted.groupBy("pair").agg(F.sum("n").alias("n")))

    # vectors of the vocabularies' lengths: exact links with those that stand in other groups, and each B id's highest count
    sent_exact = spark.sparkContext.broadcast(exact)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, more = np.zeros(size_b, np.int64), np.zeros(len(same_id), np.int64)
        for batch in batches:
            pair, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n"))
            a, b = pair >> 32, pair & 0xFFFFFFFF
            alike = same_id[a] == b
            more[a[alike]] = n[alike]
            np.maximum.at(best, b, n + np.where(alike, sent_exact.value[a], 0))
        for which, x in ((0, best), (1, more)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"which": pa.array(np.full(len(at), which), pa.int32()), "id": pa.array(at), "n": pa.array(x[at])})

    best = np.zeros(size_b, np.int64)
    for r in odd.mapInArrow(highest, "which int, id long, n long").groupBy("which", "id").agg(F.max("n").alias("n")).collect():  # a row an id of either vocabulary at most
        if r["which"]:
            exact[r["id"]] += r["n"]
        else:
            best[r["id"]] = r["n"]
    known = same_id >= 0
    np.maximum.at(best, same_id[known], exact[known])
    sent = spark.sparkContext.broadcast((exact, best, same_id))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of exact links, which need no shuffle."""
        exact, best, same_id = sent.value
        alike = np.stack([np.where(same_id >= 0, exact == best[same_id], False).astype(np.int64), exact])
        for batch in batches:
            raw = batch.column("same")
            n = pc.binary_length(raw).to_numpy(zero_copy_only=False) // np.dtype(id_type).itemsize
            ids = np.frombuffer(b"".join(x.as_py() for x in raw), id_type)
            sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(alike[:, ids], axis=1)], axis=1)[:, np.append(0, np.cumsum(n))]
            columns = [batch.column(c) for c in ("kind", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "odd")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, np.diff(sums, axis=1))], ["kind", "chunk", *figures])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["chunk"]):
            exact, best, same_id = sent.value
            kinds = table.column("kind").to_numpy()
            rows = table.filter(pa.array(kinds == DOCUMENT))
            mine = table.filter(pa.array(kinds == PAIRS))
            pair, n = mine.column("pair").to_numpy(), mine.column("n").to_numpy()
            by = np.argsort(pair)
            pair, n = pair[by], n[by]
            a, b = pair >> 32, pair & 0xFFFFFFFF
            n = np.where(same_id[a] == b, exact[a], n)
            top, n_best, count_sum = n == best[b], [], []
            for odd, x, y in zip(*(rows.column(c).to_pylist() for c in ("odd", "n_best", "count_sum")), strict=True):
                odd = np.frombuffer(odd, "<u4")
                n_best.append(x + int(top[odd].sum()))
                count_sum.append(y + int(n[odd].sum()))
            columns = [rows.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), rows.column("groups_sha256").combine_chunks()], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    figures = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "odd", "n_best", "count_sum"]
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, odd binary, n_best long, count_sum long"
    docs_of = coded.filter(f"kind = {DOCUMENT}").select("kind", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "odd").mapInArrow(summed, f"kind int, chunk long, {kinds}")
    rows = docs_of.select("*", *[F.lit(None).cast("long").alias(c) for c in ("pair", "n")])
    told = wanted.select("chunk", "pair").join(odd, "pair").select(F.lit(PAIRS).alias("kind"), "chunk", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in figures], "pair", "n")
    dealt = rows.union(told).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
