"""Encoding of whole texts with a public tokenizer, for token output and packing."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .common import texts

#: Pieces of text whose ids a task remembers; when it is full, only the pieces of the texts at hand stay.
REMEMBERED = 1_000_000
#: Longer pieces aren't remembered.
LONGEST = 64

# The two ways of splitting text for which cutting into pieces is known to change nothing.
LOWERED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
WITH_GAPS = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write visible bytes as themselves and the others as characters from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARACTERS = _byte_characters()
#: The same for a list with a line to each word: after each word stands, as a word of its own, what stands for a line end.
LINE_CHARACTERS = BYTE_CHARACTERS | {10: f"\n{BYTE_CHARACTERS[10]}\n"}

_GAP, _NEXT, _LETTER, _MARK, _LINE = 1, 2, 4, 8, 16


def _kinds() -> np.ndarray:
    """What each byte is: a gap (space or line end); the first byte of what may follow a gap at a cut (visible ASCII, or a
    character of the Latin blocks up to U+027F); an ASCII letter; a mark that is cut from a letter before it."""
    kind = np.zeros(256, np.uint8)
    kind[[32, 10]] = _GAP
    kind[10] |= _LINE
    kind[0x21:0x7F] |= _NEXT
    kind[0xC3:0xCA] |= _NEXT
    kind[[*range(65, 91), *range(97, 123)]] |= _LETTER
    kind[np.frombuffer(b"!#$%&*,.:;?", np.uint8)] |= _MARK
    return kind


_KIND = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class PieceEncoder:
    """Encodes texts to token ids (uint32), piece by piece, as the tokenizers library encodes them whole.

    For the two ways of splitting above, a pre-token begins at a space or line end that a visible ASCII or Latin
    character follows, and another ends where an ASCII letter meets common punctuation. Texts are cut there with numpy,
    and each different piece is encoded by the library once. Texts with other white space after a space or line end, or
    rarer characters there, and texts with a special token's string are encoded whole; so are all texts for vocabularies
    that split in another way. Special tokens' strings give their ids, as the library does by default; with
    special_as_text they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        way = (made["normalizer"], made["pre_tokenizer"])
        added = made["added_tokens"]
        plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.lowered = plain and way == LOWERED
        self.with_gaps = plain and way == WITH_GAPS
        self.special = [t["content"].encode().lower() for t in added]
        #: One word of Latin letters is one pre-token (with the space before it, or without).
        self.latin = re.compile(" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+".encode("latin-1")).fullmatch
        #: The same model for such words alone, one to a line.
        self.by_word = Tokenizer(self.tokenizer.model)
        self.by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = self.by_word.encode(BYTE_CHARACTERS[10]).ids[0]
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that aren't known yet."""
        latin = self.latin if self.lowered or self.with_gaps else lambda _: None
        words = [k for k, p in enumerate(pieces) if len(p) <= LONGEST and latin(p)]
        ids: list[bytes | None] = [None] * len(pieces)
        if words:
            lines = b"\n".join([pieces[k] for k in words]) + b"\n"
            lines = lines.decode().lower().encode() if self.lowered else lines
            flat = np.array(self.by_word.encode_batch_fast([lines.decode("latin-1").translate(LINE_CHARACTERS)])[0].ids, "<u4")
            ends = np.flatnonzero(flat == self.mark)
            raw, starts = flat.tobytes(), np.append(0, ends[:-1] + 1)
            for k, a, b in zip(words, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                ids[k] = raw[a:b]
        for k, p in enumerate(pieces):
            if ids[k] is None:
                ids[k] = np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, where pieces start in them, and the first piece of each row (with the end)."""
        starts = np.zeros(len(data), bool)
        rows = offsets[:-1][np.diff(offsets) > 0]
        starts[rows] = True
        if not (self.lowered or self.with_gaps):
            at = np.flatnonzero(starts)
            return data, at, np.searchsorted(at, offsets)
        kind = _KIND[data]
        after = np.zeros(len(data), np.uint8)
        after[:-1] = kind[1:]
        after[offsets[1:][np.diff(offsets) > 0] - 1] = 0
        before = np.zeros(len(data), np.uint8)
        before[1:] = kind[:-1]
        gap = (kind & _GAP).astype(bool)
        low = _LOWER[data]
        odd = [np.flatnonzero(gap & (after & _NEXT == 0))]
        raw = low.tobytes()
        for s in self.special:
            x = raw.find(s)
            while x >= 0:
                odd.append(np.array([x]))
                x = raw.find(s, x + 1)
        whole = np.unique(np.searchsorted(offsets, np.concatenate(odd), side="right") - 1)
        inner = ((before & _LETTER) >> 2 & (kind & _MARK) >> 3).astype(bool)
        inner |= (before & (_GAP if self.lowered else _LINE)).astype(bool)
        if self.with_gaps:
            inner |= gap
        for r in whole.tolist():
            inner[offsets[r] : offsets[r + 1]] = False
            gap[offsets[r] : offsets[r + 1]] = False
        starts |= inner
        at = np.flatnonzero(starts)
        if self.lowered:
            for r in whole.tolist():
                low[offsets[r] : offsets[r + 1]] = data[offsets[r] : offsets[r + 1]]
            gone = np.flatnonzero(gap)
            data, at, offsets = low[~gap], at - np.searchsorted(gone, at), offsets - np.searchsorted(gone, offsets)
            at = at[np.append(at[1:] > at[:-1], at[-1:] < len(data))]
        return data, at, np.searchsorted(at, offsets)

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of each text's; null counts as empty."""
        data, at, first = self.cut(*texts(column))
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        ends = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which, raw = pieces.indices.to_numpy(), pieces.dictionary.buffers()[2].to_pybytes()
        bounds = np.frombuffer(pieces.dictionary.buffers()[1], np.int32)[: len(pieces.dictionary) + 1].tolist()
        names = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        known = self.known
        found = [known.get(p) for p in names]
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self.learn([names[k] for k in new]), strict=True):
            found[k] = x
            if len(names[k]) <= LONGEST:
                known[names[k]] = x
        if len(known) > self.remembered:
            self.known = {p: x for p, x in zip(names, found, strict=True) if len(p) <= LONGEST}
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begin = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        n = size[which]
        total = np.append(0, np.cumsum(n))
        out = ids[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])]
        return out, np.diff(total[first])

    def with_end(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an end id after each text's."""
        ids, n = self.many(column)
        after = np.cumsum(n + 1)
        out = np.empty(len(ids) + len(n), np.uint32)
        place = np.ones(len(out), bool)
        place[after - 1] = False
        out[place], out[after - 1] = ids, end
        return out, n + 1


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each vocabulary and Python worker: what it has learnt serves the worker's next tasks too."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def as_binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian uint32 bytes, without a copy."""
    ends = np.append(0, np.cumsum(4 * n)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
