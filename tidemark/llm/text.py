"""Vectorised text helpers for use inside Spark tasks.

Arrow string columns are seen as one UTF-8 buffer with offsets, so that words,
shingles and their hashes are numpy operations over whole slices of a batch and
never a Python loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Just under a power of two, as tables of powers are that long.
SLICE_BYTES = (2 << 20) - 64
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NON_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text, one row at least."""
    sizes = np.diff(_offsets(batch.column(column)))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _large(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    return column if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_binary())


def _offsets(column) -> np.ndarray:
    column = _large(column)
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and n + 1 offsets; a null is empty."""
    column = _large(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(column)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross rows: starts, ends, and offsets of each row's runs."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


def _power_pair(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(15, -(-(int(n) - 1).bit_length() // 3) * 3)
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


@lru_cache(4)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_BASE) + _U(seed))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power_pair(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inverse = _power_pair(base, len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


#: Byte ranges of up to so many bytes are hashed by numpy. The polynomial is one modulo 2 ** 64, in which long periodic
#: differences cancel out; below this length no difference of two bytes loses more than 20 of its 64 bits.
SHORT = 32


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes have equal hashes wherever they stand. Ranges longer than SHORT get xxh3's."""
    out = span(prefix(_byte_values(seed)[buf], _BASE), starts, ends, _BASE)
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        out[long] = range_hashes(buf, starts[long], ends[long], seed)
    return out


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """xxh3 of each byte range: one call for each, for ranges that are few for their bytes."""
    view = memoryview(np.ascontiguousarray(buf))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), _U, len(starts))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes; those that cross rows are the caller's to leave out.

    A polynomial modulo 2 ** 64 over hashes that are random themselves: two sequences of under 64 words that are built of the
    same two words agree with 2 ** -38 at most."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums = prefix(words, _WORD_BASE)
    return mix((sums[k:] - sums[:-k]) * _power_pair(_WORD_BASE, len(sums))[1][:n] + _U(k))


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of UTF-8 bytes, and the bytes that start none. In bytes that are not UTF-8 each is a character."""
    raw = buf.tobytes()
    if raw.isascii():
        return np.frombuffer(raw, np.uint8), np.zeros(0, np.int64)
    try:
        return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.flatnonzero((buf & 0xC0) == 0x80)
    except UnicodeDecodeError:
        return np.frombuffer(raw, np.uint8), np.zeros(0, np.int64)


def char_grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive characters, by doubling."""
    if len(codes) < k:
        return np.zeros(0, _U)
    power, out, done, width = np.multiply(codes, _U(_WORD_BASE), dtype=_U), None, 0, 1
    while True:
        step = _U(pow(_BASE, width, 1 << 64))
        if k & width:
            if out is None:
                out = power
            else:
                n = len(codes) - done - width + 1
                out = out[:n] * step
                out += power[done : done + n]
            done += width
        if done == k:
            break
        longer = power[:-width] * step
        longer += power[width:]
        power, width = longer, 2 * width
    out ^= out >> _U(32)
    out *= _U(0x94D049BB133111EB)
    out ^= out >> _U(29)
    return out


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of word hashes of any length, by xxh3."""
    return range_hashes(np.ascontiguousarray(words).view(np.uint8), 8 * starts, 8 * ends)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in row order, and how many each row has; a row of 1 to k - 1 words is one shingle."""
    counts = np.diff(offsets)
    grams = gram_hashes(words, k)
    size = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.flatnonzero(counts >= k)
    held = inside(len(grams), offsets[whole], offsets[whole + 1] - k + 1)
    if not len(short):
        return grams[held], size
    out = np.empty(int(size.sum()), _U)
    first = np.cumsum(size) - size
    own = np.zeros(len(out), bool)
    own[first[short]] = True
    out[~own] = grams[held]
    out[own] = sequence_hashes(words, offsets[short], offsets[short + 1])
    return out, size


def inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges, none of which overlap or are empty."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def one_permutation(hashes: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """MinHash by one permutation of ``counts`` hashes for each row, rows x bins of 32 bits: a bin's least hash; an empty bin
    takes that of the first filled bin on a probe sequence that is the same for all rows.
    Rows without hashes are all ones."""
    empty, n_rows = np.uint32(0xFFFFFFFF), len(counts)
    out = np.full(n_rows * bins, empty, np.uint32)
    if len(hashes):
        at = hashes >> _U(32)
        at *= _U(bins)
        at >>= _U(32)
        at = at.view(np.int64)
        at += np.repeat(np.arange(0, n_rows * bins, bins), counts)
        value = hashes.astype(np.uint32)
        value &= np.uint32(0xFFFFFFFE)
        np.minimum.at(out, at, value)
    out = out.reshape(n_rows, bins)
    hole = (out == empty) & (out != empty).any(1)[:, None]
    step = 1
    filled = out
    while hole.any():
        row, col = np.nonzero(hole)
        probe = mix(col.astype(_U) * _U(_BASE) + _U(step * 7919)) % _U(bins) if step < 64 else (col + step).astype(_U) % _U(bins)
        value = out[row, probe.astype(np.int64)]
        got = value != empty
        if filled is out:
            filled = out.copy()
        filled[row[got], col[got]] = value[got]
        hole[row[got], col[got]] = False
        step += 1
    return filled


def word_bags(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, grams: tuple[int, ...], buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams of bytes, with a mark at either end, and of itself; and offsets of each word's."""
    size = ends - starts + 2
    bounds = np.append(0, np.cumsum(size))
    padded = np.empty(bounds[-1], np.uint8)
    inner = np.ones(len(padded), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    padded[bounds[:-1]], padded[bounds[1:] - 1] = 0x3C, 0x3E
    padded[inner] = buf[np.repeat(starts - bounds[:-1] - 1, size - 2) + np.flatnonzero(inner)]
    counts = np.stack([np.ones_like(size), *(np.maximum(size - n + 1, 0) for n in grams)], 1)
    at = np.append(0, np.cumsum(counts.sum(1)))
    begin = at[:-1, None] + np.cumsum(counts, 1) - counts
    out = np.empty(at[-1], np.int64)
    out[begin[:, 0]] = (byte_hashes(padded, bounds[:-1], bounds[1:], seed) % _U(buckets)).astype(np.int64)
    sums = prefix(_byte_values(seed)[padded], _BASE)
    for k, n in enumerate(grams, 1):
        owner = np.repeat(np.arange(len(size)), counts[:, k])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts[:, k]) - counts[:, k], counts[:, k])
        first = bounds[:-1][owner] + step
        out[begin[owner, k] + step] = (span(sums, first, first + n, _BASE) % _U(buckets)).astype(np.int64)
    return out, at


def to_binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as binary values."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int64) * width
    return blobs(matrix.reshape(-1).view(np.uint8), offsets)


def blobs(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """A binary column over the bytes between the offsets."""
    kind = kind or pa.binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def from_binary(column, dtype, width: int) -> np.ndarray:
    data, _ = utf8(column)
    return data.view(dtype).reshape(-1, width) if len(data) else np.zeros((0, width), dtype)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == _U else values.astype(np.int64))


def unsigned(column) -> np.ndarray:
    """A non-null long column as unsigned values."""
    return np.asarray(column).astype(np.int64, copy=False).view(_U)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, sized: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """A partition that is sorted by ``key``, in tables of whole groups: cut at the first end of a
    group once column ``sized`` holds ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            keys = np.asarray(batch.column(key))
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, batch.num_rows)
            if held and keys[0] != held[-1].column(key)[-1].as_py() and size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            sums = np.cumsum(np.diff(_offsets(batch.column(sized))))
            stop = int(ends[min(int(np.searchsorted(size + sums[ends - 1], limit)), len(ends) - 1)])
            held.append(batch.slice(0, stop))
            size += int(sums[stop - 1])
            batch = batch.slice(stop)
    if held:
        yield pa.Table.from_batches(held)
