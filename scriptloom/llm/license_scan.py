"""Fuzzy search for short license notices.

A text is normalised to lower-case words with one space between. A phrase that may have k edits is split into k + 1
parts: by the pigeonhole principle a place with at most k edits holds one part unchanged, so exact search for the parts
finds every candidate. Around each candidate the regex library's bounded-error matching verifies the phrase, and tells
its span and edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Phrases with their labels; those that the base search looks for, and more short notices for the fuzzy search alone.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd", "creative commons attribution": "cc-by", "creative commons zero": "cc0",
    "eclipse public license": "epl", "boost software license": "boost", "european union public licence": "eupl", "artistic license": "artistic", "isc license": "isc", "zlib license": "zlib", "microsoft public license": "ms-pl",
    "python software foundation license": "psf", "common development and distribution license": "cddl", "open software license": "osl", "all rights reserved": "proprietary",
}
#: One edit is allowed for each so many characters.
CHARS_PER_EDIT = 8

#: A-Z to lower case, and what isn't in a word to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_TABLE).split())


class Phrase:
    def __init__(self, phrase: str, label: str):
        self.phrase, self.label, self.edits = phrase, label, len(phrase) // CHARS_PER_EDIT
        n = self.edits + 1
        cuts = [len(phrase) * i // n for i in range(n + 1)]
        #: Exact seeds and where they stand in the phrase.
        self.seeds = [(phrase[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.match = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase)}){{e<={self.edits}}}(?![^ ])".encode()).search

    def found(self, padded: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) in the normalised text, without those that overlap an earlier one."""
        n, k = len(self.phrase), self.edits
        windows = set()
        for seed, offset in self.seeds:
            at = padded.find(seed)
            while at >= 0:
                windows.add(at - offset)
                at = padded.find(seed, at + 1)
        spans, last = [], -1
        for start in sorted(windows):
            lo, hi = max(0, start - k), min(len(padded), start + n + k)
            # beyond hi, so that the look-ahead sees the rest of a word that hi cuts; no match can end or begin in that rest
            end = padded.find(b" ", hi, hi + n + k + 1)
            m = self.match(padded, max(lo - 1, 0, last), end if end >= 0 else min(len(padded), hi + n + k + 1))
            if m and m.end() > m.start() >= last:
                spans.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                last = m.end()
        return spans


def places(text: bytes, phrase: bytes) -> list[int]:
    """Byte offsets at which the phrase's words stand consecutively in a normalised text."""
    padded, want = b" " + text + b" ", b" " + phrase + b" "
    found, at = [], padded.find(want)
    while at >= 0:
        found.append(at)
        at = padded.find(want, at + 1)
    return found


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_fuzzy", pa.int64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("matched", pa.string())])))]
)


def scan_text(text: str | None, fuzzy: list[Phrase]) -> tuple:
    words = normalised(text)
    gaps, starts, base = np.flatnonzero(np.frombuffer(words, np.uint8) == 32), [], set()
    for phrase, label in BASE_PHRASES.items():
        if at := places(words, phrase.encode()):
            starts += np.searchsorted(gaps, at).tolist()  # words before a place, from the gaps before it
            base.add(label)
    spans, score = [], 1.0 if base else 0.0
    for p in fuzzy:
        if p.edits or p.phrase not in BASE_PHRASES:
            for start, end, edits in p.found(words):
                spans.append({"label": p.label, "start": start, "end": end, "edits": edits, "matched": words[start:end].decode(errors="replace")})
                score = max(score, 1 - edits / len(p.phrase))
    labels = base | {s["label"] for s in spans}
    return (len(gaps) + 1 if words else 0, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(spans), spans)


def license_scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_words; n_base, first_word, last_word and base_labels of the exact search; labels, score
    (best share of unchanged characters), n_fuzzy and spans (label, start, end, edits, matched; offsets into the
    normalised UTF-8 text) with the fuzzy search for `phrases`.

    A null, empty or wordless text has no words, no places, empty labels and score 0. Spans of one phrase do not
    overlap, begin and end with words, and ties go to the earlier place. Very long texts are scanned whole. Extra columns
    are ignored; repeated rows are scanned alike; no rows give no rows.
    """
    wanted = phrases if phrases is not None else BASE_PHRASES | MORE_PHRASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = [Phrase(p, label) for p, label in wanted.items()]
        for batch in slices(batches, "text", 4 << 20):
            rows = zip(*(scan_text(t, fuzzy) for t in batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), _SCHEMA.types[k + 1]) for k, c in enumerate(rows))], schema=_SCHEMA)

    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_fuzzy long, spans array<struct<label:string,start:int,end:int,edits:int,matched:string>>"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, out)
