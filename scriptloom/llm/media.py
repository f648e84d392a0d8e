"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM samples to resampled 16-bit PCM.

The two companded forms are expanded by lookup tables of 256 entries, built from their definitions. ADPCM blocks are
decoded with numpy across blocks: one step for each nibble position, all blocks of a batch at once. PCM is resampled
in whole numbers, to twice the rate by linear interpolation or to a quarter of it by means of samples, and stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

RATE, UNIT, PAD = 8000, 576, 255
#: Samples that are one in the stored PCM.
REDUCED = 4
FORMATS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}

# Fixed values of the ADPCM format: index changes by code, and 89 step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    mantissa, exponent = code & 15, code >> 4 & 7
    size = np.where(exponent > 0, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0), (mantissa << 4) + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8, a row for each block: predictor (int16), step index, a spare byte, then two codes a byte, low first.
    Returns int16, a row for each block, its predictor first."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2], 0, len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * len(codes)):
        code = (codes[k >> 1] >> (4 * (k & 1)) & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next (the last is repeated), rounded down."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    after = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def reduced(pcm: np.ndarray, times: int = REDUCED) -> np.ndarray:
    """A lower rate: means of so many samples each, rounded down (the last may be of fewer)."""
    first = np.arange(0, len(pcm), times)
    size = np.minimum(times, len(pcm) - first)
    return (np.add.reduceat(pcm.astype(np.int32), first) // size).astype(np.int16) if len(pcm) else pcm


def to_wav(payload: bytes, codec: str = "mulaw", rate: int = RATE, block: int = UNIT) -> bytes:
    """A RIFF file with the payload as its samples, unchanged."""
    if codec == "ima_adpcm":
        fmt = struct.pack("<HHIIHHHH", FORMATS[codec], 1, rate, rate // 2, block, 4, 2, 2 * (block - 4) + 1)
        n = len(payload) // block * (2 * (block - 4) + 1)
    else:
        fmt, n = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate, 1, 8, 0), len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, block size and sample bytes of such a file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF audio")
    at, codec, block, data = 12, None, 1, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, _, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            codec = next((k for k, v in FORMATS.items() if v == tag), None)
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if codec is None or data is None:
        raise ValueError("unknown audio")
    return codec, block, data


def decode(codec: str, block: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if codec == "mulaw":
        return MULAW[raw]
    if codec == "alaw":
        return ALAW[raw]
    return adpcm(raw[: len(raw) // block * block].reshape(-1, block)).reshape(-1)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes([PAD]) * ((-len(data)) % unit if data else unit)


_STORED = "doc_id long, n_bytes long, media binary, pcm binary"
_PCM = "doc_id long, n_bytes long, media binary, payload binary, mulaw binary, alaw binary, adpcm binary"


def store_text_audio(docs: DataFrame, *, codec: str = "mulaw", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as samples of a RIFF
    file; and pcm: these samples expanded by the file's codec, at a quarter of the rate, as little-endian int16. A null text counts
    as empty (576 bytes of padding); very long texts go whole. Null and repeated keys and repeated rows are stored each; extra
    columns are ignored; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            payload = [padded(x) for x in raw]
            ends = np.cumsum([len(x) for x in payload])
            pcm = decode(codec, UNIT, b"".join(payload))  # whole blocks, so all texts at once
            own = [reduced(x).astype("<i2").tobytes() for x in np.split(pcm, ends[:-1] * len(pcm) // ends[-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(x, codec) for x in payload], pa.binary()), pa.array(own, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _STORED)


def resampled(media: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each file its sample bytes, and them read as each of the three codecs, at twice the rate. The ADPCM blocks of
    all files are decoded together."""
    data = [from_wav(x)[2] for x in media]
    whole = [len(x) // UNIT for x in data]
    blocks = np.frombuffer(b"".join(x[: n * UNIT] for x, n in zip(data, whole, strict=True)), np.uint8).reshape(-1, UNIT)
    pcm, ends = adpcm(blocks), np.cumsum(whole)
    out = []
    for x, n, end in zip(data, whole, ends, strict=True):
        raw = np.frombuffer(x, np.uint8)
        out.append((x, doubled(MULAW[raw]), doubled(ALAW[raw]), doubled(pcm[end - n : end].reshape(-1))))
    return out


def audio_columns(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, its sample bytes as read back (payload), and PCM at twice the rate as little-endian int16:
    mulaw, alaw and adpcm (the samples read as each codec). Rows that repeat come each; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            media = batch.column("media").to_pylist()
            cols = zip(*((d, *(x.astype("<i2").tobytes() for x in p)) for d, *p in resampled(media)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), *(pa.array(list(c), pa.binary()) for c in cols)], ["doc_id", "n_bytes", "media", "payload", "mulaw", "alaw", "adpcm"])

    return stored.mapInArrow(run, _PCM)


def features(pcm: np.ndarray) -> str:
    """Peak, root mean square (rounded down), zero crossings and crc32 of 16-bit PCM."""
    wide = pcm.astype(np.int64)
    signs = pcm >= 0
    return f"{int(np.abs(wide).max())}:{int(np.sqrt(np.mean(wide * wide)))}:{int(np.count_nonzero(signs[1:] != signs[:-1]))}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def audio_digests(stored: DataFrame) -> DataFrame:
    """Of each stored file: payload and media sizes and hashes, and a feature string of the stored PCM and of the samples'
    PCM at twice the rate by the three codecs. The latter is the same as digesting audio_columns(), without carrying it
    through Spark. Rows that repeat come each; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            media, rows = batch.column("media").to_pylist(), []
            for doc, n, x, kept, (payload, *pcm) in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), media, batch.column("pcm").to_pylist(), resampled(media), strict=True):
                told = " ".join(f"{k}={features(p)}" for k, p in zip(("stored", "mulaw", "alaw", "adpcm"), (np.frombuffer(kept, "<i2"), *pcm), strict=True))
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).hexdigest(), told))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
