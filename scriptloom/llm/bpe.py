"""BPE encoding and decoding with forced boundaries.

Two bytes that stand side by side inside no token of the vocabulary must be in different tokens wherever they meet, so
the text may be cut between them: the fragments are encoded on their own and their ids put together, and the result is
that of the whole text. Cuts are taken from coarse to fine. Whole texts are cut at spaces first (no token of a
vocabulary with word ends holds one); each different piece is then brought to its pre-tokens, and these are cut at
every pair that the table of the vocabulary's pairs hasn't got. A fragment before such a cut is no word end, so where
the vocabulary marks word ends it is encoded by the same merges without the mark.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import BYTE_CHARACTERS, LONGEST, PieceEncoder, as_binary

VOCABULARY = "word_bpe_49k.json"
#: Fragments of each kind whose ids a task remembers, besides the pieces that the base class remembers.
FRAGMENTS = 100_000
_BYTES = {c: b for b, c in BYTE_CHARACTERS.items()}
_CHARACTERS = [BYTE_CHARACTERS[b] for b in range(256)]


def pairs_in(merges: list) -> np.ndarray:
    """pairs[a, b]: byte a stands right before byte b in some token. A token's inner pairs are where the merges that make it join."""
    pairs = np.zeros((256, 256), bool)
    for merge in merges:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[_BYTES[left[-1]], _BYTES[right[0]]] = True
    return pairs


class ForcedEncoder(PieceEncoder):
    """A PieceEncoder that cuts pre-tokens at forced boundaries and encodes each different fragment once."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, special_as_text)
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("forced boundaries need plain byte-level BPE merges")
        suffix = model["end_of_word_suffix"] or ""
        self.ends = bool(suffix)
        self.forced = ~pairs_in(model["merges"])
        space = self.forced[32].copy()
        space[32] = True
        if self.lowered and not space.all():
            self.lowered = False  # a token holds a space: such texts aren't cut at spaces
        self.inner = Tokenizer.from_str(json.dumps(made | {"model": model | {"end_of_word_suffix": None}, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}))
        self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        special = [] if special_as_text else [t["content"] for t in made["added_tokens"]]
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: Ids of fragments inside a word, and of fragments that end one.
        self.fragments: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})

    def pre_tokens(self, piece: bytes) -> list[bytes | int]:
        """The pre-tokens of a piece, as bytes; a special token's string is its id."""
        if len(piece) <= LONGEST and (self.lowered or self.with_gaps) and self.latin(piece):
            return [piece.decode().lower().encode() if self.lowered else piece]
        text, out = piece.decode(), []
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for k, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                part = normal.normalize_str(part) if normal else part
                out += [bytes(map(_BYTES.__getitem__, word)) for word, _ in split.pre_tokenize_str(part)]
        return out

    def encode_fragments(self, fragments: list[bytes], end: bool) -> None:
        """Learns the ids of fragments; `end` if they end words."""
        known = self.fragments[end]
        if len(known) + len(fragments) > FRAGMENTS:
            known.clear()
        line = " ".join("".join(map(_CHARACTERS.__getitem__, f)) for f in fragments)
        coded = (self.by_word if end else self.inner).encode(line, add_special_tokens=False)
        ids = np.array(coded.ids, "<u4")
        cuts = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(fragments) + 1)) * 4
        raw = ids.tobytes()
        for f, a, b in zip(fragments, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            known[f] = raw[a:b]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        parts = [self.pre_tokens(p) for p in pieces]
        words = [w for ws in parts for w in ws if not isinstance(w, int)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = self.forced[data[:-1], data[1:]]
        starts[np.append(0, ends)] = True
        cuts = np.flatnonzero(starts)
        last = np.isin(cuts[1:], ends) if self.ends else np.zeros(max(0, len(cuts) - 1), bool)
        raw = data.tobytes()
        frags = [raw[a:b] for a, b in itertools.pairwise(cuts.tolist())]
        ids: list[bytes | None] = [None] * len(frags)
        for end in (False, True):
            mine = np.flatnonzero(last == end).tolist()
            known = self.fragments[end]
            new = {frags[k] for k in mine} - known.keys()
            if new:
                if len(known) + len(new) > FRAGMENTS:  # what this call needs stays
                    new = {frags[k] for k in mine}
                self.encode_fragments(list(new), end)
            for k in mine:
                ids[k] = known[frags[k]]
        per_word = np.diff(np.searchsorted(cuts[:-1], np.append(0, ends))).tolist()
        at, word, out = 0, 0, []
        for ws in parts:
            mine = []
            for w in ws:
                if isinstance(w, int):
                    mine.append(np.array([w], "<u4").tobytes())
                else:
                    mine += ids[at : at + per_word[word]]
                    at, word = at + per_word[word], word + 1
            out.append(b"".join(mine))
        return out


_encoders: dict[str, ForcedEncoder] = {}


def forced_encoder(path: str) -> ForcedEncoder:
    """One for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = ForcedEncoder(path)
    return _encoders[path]


_decoders: dict[str, tuple] = {}


def decoder(path: str) -> tuple:
    """The names of all ids, where a text is its tokens joined by spaces; else the tokenizer. One for each vocabulary and worker."""
    if path not in _decoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        names = [tokenizer.id_to_token(k) for k in range(1 + max(tokenizer.get_vocab(with_added_tokens=True).values()))]
        _decoders[path] = (names, None) if tokenizer.decoder is None and None not in names else (None, tokenizer)
    return _decoders[path]


def decode_ids(ids: np.ndarray, names: list[str] | None, tokenizer) -> str:
    if names is None:
        return tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    return " ".join(map(names.__getitem__, ids[ids < len(names)].tolist()))


def encode(docs: DataFrame, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids (little-endian uint32 bytes), as the tokenizers library encodes the
    whole text without adding special tokens, truncation or padding.

    Null and empty texts have no ids. Very long texts are encoded whole. Null and repeated keys and repeated rows are
    rows like others; extra columns are ignored; no rows give no rows. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = forced_encoder(path or public_tokenizers.path(VOCABULARY))
        for batch in slices(batches, "text", 1 << 20):
            ids, n = coder.many(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), as_binary(ids, n)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, *, path: str | None = None) -> DataFrame:
    """coded (doc_id, n_tokens, ids) with decoded, the text of the ids as the library's decode(ids, skip_special_tokens=False)
    gives it. No ids or null give the empty text; ids that the vocabulary hasn't got give nothing; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = decoder(path or public_tokenizers.path(VOCABULARY))
        for batch in slices(batches, "ids", 1 << 20):
            texts = [decode_ids(np.frombuffer(x.as_py() or b"", "<u4"), *how) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
