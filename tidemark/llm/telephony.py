"""Telephony audio columns (op2): mu-law and A-law by lookup tables, IMA ADPCM by blocks, resampled PCM.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are stored as the 8-bit samples
of a WAV file (8 kHz, mono, G.711 mu-law). Reading back takes the samples from the file's
data chunk and computes features: energy, peak and sign changes of the mu-law expansion, energy
and peak of the A-law one and of the bytes as 64-byte IMA ADPCM blocks. The mu-law PCM, resampled to ``STORED`` Hz,
is stored as well, and its CRC is taken from what is read back. ``pcm`` gives PCM of any of the three codecs at 4 or 16 kHz.

Samples are decoded as whole arrays: expansions are one gather; ADPCM, sequential within a block,
is one step over all blocks of a slice for each nibble. Defined cases: a null or empty text is 64 zero
bytes; a text that fills 64 bytes gets no padding; a null doc_id and equal rows pass through;
very long texts are whole files; an empty table gives no rows; bytes that are not a WAV file of this kind raise an error;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spread, text

BLOCK = 64
RATE = 8000
#: Rate of the PCM that ``features`` stores; 16 kHz would take four bytes a payload byte.
STORED = 4000
#: Compression level of the stored tables.
LEVEL = 9
SLICE = 1 << 20

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mu_law() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, size + 8, size + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor and 16 times the next index, for 16 * index + nibble."""
    nibble, step = np.arange(16)[None, :], STEPS[:, None]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + MOVES[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).reshape(-1), (16 * following).astype(np.int32).reshape(-1)


MU_LAW, A_LAW = _mu_law(), _a_law()
CHANGE, FOLLOWING = _adpcm()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """Samples of 64-byte IMA ADPCM blocks: one of the header and 120 nibbles, low ones first."""
    blocks = data.reshape(-1, BLOCK)
    out = np.empty((2 * (BLOCK - 4) + 1, len(blocks)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = 16 * np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for j, code in enumerate(codes):
        for k, nibble in enumerate((code & 15, code >> 4)):
            at = index + nibble
            value = np.minimum(np.maximum(value + CHANGE[at], -32768), 32767)
            index = FOLLOWING[at]
            out[2 * j + k + 1] = value
    return np.ascontiguousarray(out.T)


def double_rate(pcm: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Twice the samples: each one, then the cubic midpoint to the next; a row's ends repeat."""
    x = pcm.astype(np.int32)
    last = np.zeros(len(x), bool)
    last[offsets[1:] - 1] = True
    first = np.zeros(len(x), bool)
    first[offsets[:-1]] = True
    after = np.where(last, x, np.append(x[1:], 0))
    before = np.where(first, x, np.append(0, x[:-1]))
    second = np.append(after[1:], 0)
    second = np.where(last, x, np.where(np.append(last[1:], True), after, second))
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip((9 * (x + after) - before - second + 8) >> 4, -32768, 32767)
    return out


def half_rate(pcm: np.ndarray) -> np.ndarray:
    """Half of the samples: the mean of each two. Rows have an even number."""
    x = pcm.astype(np.int32)
    return ((x[0::2] + x[1::2] + 1) >> 1).astype(np.int16)


def wav(samples: bytes) -> bytes:
    """A mu-law WAV file of one channel."""
    fmt = struct.pack("<HHIIHHH", 7, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_at(media: memoryview) -> tuple[int, int]:
    """Where the samples of a mu-law WAV file start, and how many there are."""
    if bytes(media[:4]) != b"RIFF" or bytes(media[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, (size,) = bytes(media[at : at + 4]), struct.unpack("<I", media[at + 4 : at + 8])
        if kind == b"fmt " and struct.unpack("<HH", media[at + 8 : at + 12]) != (7, 1):
            raise ValueError("not mu-law of one channel")
        if kind == b"data":
            return at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file."""

    def rows(batches):
        for batch in batches:
            for part in text.slices(batch, limit=SLICE):
                buf, offsets = text.utf8(part.column("text"))
                view, n = memoryview(buf), np.diff(offsets)
                pad = np.maximum(-(-n // BLOCK), 1) * BLOCK - n
                media = [wav(bytes(view[a : a + k]) + bytes(int(p))) for a, k, p in zip(offsets, n, pad, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text.longs(n), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return spread.slim(docs).select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def _payloads(batches):
    """Slices with the samples of all their files as one array, and its offsets."""
    for batch in batches:
        for part in text.slices(batch, "media", SLICE):
            buf, offsets = text.utf8(part.column("media"))
            view = memoryview(buf)
            at = np.array([samples_at(view[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64).reshape(-1, 2)
            start, size = offsets[:-1] + at[:, 0], at[:, 1]
            ends = np.append(0, np.cumsum(size))
            data = buf[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            yield part, view, offsets, data, ends


def features(media: DataFrame) -> DataFrame:
    """The stored files read back: digests of the samples and of the file, and the feature string."""

    def rows(batches):
        for part, view, offsets, data, ends in _payloads(batches):
            mu, a = MU_LAW[data].astype(np.int64), A_LAW[data].astype(np.int64)
            block = decode_adpcm(data).astype(np.int64)
            at, blocks = ends[:-1], ends[:-1] // BLOCK
            sign = mu < 0
            turn = np.zeros(len(mu), np.int64)
            turn[1:] = sign[1:] != sign[:-1]
            turn[at] = 0
            power = (block * block).sum(1)
            table = [np.add.reduceat(mu * mu, at), np.maximum.reduceat(np.abs(mu), at), np.add.reduceat(turn, at), np.add.reduceat(a * a, at), np.maximum.reduceat(np.abs(a), at), np.add.reduceat(power, blocks), np.maximum.reduceat(np.abs(block).max(1), blocks)]
            samples = memoryview(data)
            out = []
            for i, (s, e) in enumerate(zip(ends, ends[1:], strict=False)):
                v = [int(x[i]) for x in table]
                own = samples[s:e]
                out.append((int(e - s), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-BLOCK:]), int(offsets[i + 1] - offsets[i]), hashlib.sha256(view[offsets[i] : offsets[i + 1]]).hexdigest(),
                            f"mulaw:{v[0]}:{v[1]}:{v[2]};alaw:{v[3]}:{v[4]};adpcm:{v[5]}:{v[6]}"))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            resampled = text.blobs(half_rate(MU_LAW[data]).astype("<i2").view(np.uint8), ends)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), resampled], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"])

    told = media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")
    told = spread.stored(told, "pcm", "zstd", LEVEL)
    mark = F.concat(F.col("feature"), F.lit(f";pcm{STORED // 1000}k:"), F.lower(F.lpad(F.hex(F.crc32("pcm")), 8, "0")))
    return told.withColumn("feature", mark).drop("pcm")


def pcm(media: DataFrame, codec: str = "mulaw", rate: int = 2 * RATE) -> DataFrame:
    """doc_id, rate, pcm: little-endian 16-bit samples at 16 kHz or 4 kHz, for a caller to store."""
    if codec not in ("mulaw", "alaw", "adpcm"):
        raise ValueError(f"no such codec: {codec}")
    if rate not in (2 * RATE, RATE // 2) or (codec == "adpcm" and rate < RATE):
        raise ValueError(f"no such rate: {rate}")

    def rows(batches):
        for part, _, _, data, ends in _payloads(batches):
            if codec == "adpcm":
                x, at = decode_adpcm(data).reshape(-1), ends // BLOCK * (2 * (BLOCK - 4) + 1)
            else:
                x, at = (MU_LAW if codec == "mulaw" else A_LAW)[data], ends
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(part.num_rows, rate, np.int32)), text.blobs((double_rate(x, at) if rate > RATE else half_rate(x)).astype("<i2").view(np.uint8), 4 * at if rate > RATE else at)], names=["doc_id", "rate", "pcm"])

    return media.mapInArrow(rows, "doc_id long, rate int, pcm binary")


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spread.stored(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "zstd", LEVEL))
