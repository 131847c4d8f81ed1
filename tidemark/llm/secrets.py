"""Secret scan by a battery of randomness tests (op7), on top of three fixed patterns.

Candidates are runs of at least ``SHORTEST`` characters of ``[A-Za-z0-9+/_=-]``. Each one's encoding is inferred
from its characters (hexadecimal, base 32, base 36, base 64); over that alphabet a chi-squared test of
uniformity, a runs test about the middle symbol and a test of serial correlation give three
normal scores, of which the largest says how far the string is from random.

How often ordinary text looks so random is counted over all documents: their words, without
the candidates, are joined and cut into strings of the lengths in question, and scored in the
same way. That gives p-values per encoding and length class; below the scores that ordinary strings reach, the tail is
carried on as an exponential, so that p-values have no floor. In each class the cut-off on the
score is the largest at which the expected share of false discoveries stays below ``rate``. Candidates count
once for each distinct string, and not at all if they consist of one or two symbols (rules, padding).
The table of counts has a fixed number of cells.

Patterns (fixed): assign, access, hex, as leftmost matches that don't overlap, of which those too short are dropped.
Findings that overlap one of them are not added. Defined cases: a null or empty text has
no spans; equal rows get equal results; a null doc_id passes through; places are code points,
ends exclusive; very long texts are whole; a finding's score on a cell's edge counts to the higher cell; an empty table gives no
rows; random strings under ``SHORTEST`` characters are not looked for; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spread, text

# The patterns of the base scan and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

SHORTEST, RATE = 20, 0.01
#: Length classes: lower ends, and the length of ordinary strings that stand for each.
CLASSES, PIECES = np.array([20, 24, 32, 48, 64, 128]), np.array([22, 28, 40, 56, 96, 160])
SCORES, STEP = 256, 0.125
#: A finding must itself pass the three tests at so many standard deviations, however rare its like is in ordinary text.
ACCEPT = 4.0
#: The tail is fitted between the scores that so many ordinary strings, and the square of that, come up to.
FEW = 10
HEX = text.byte_class((0x30, 0x39), (0x61, 0x66))
TOKEN = text.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x5F, 0x5F), (0x3D, 0x3D), (0x2D, 0x2D))
#: Alphabets in the order in which they are tried; the two spellings of the last two symbols of base 64 are one.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
SIZES = np.array([len(a) for a in ALPHABETS])


def _tables() -> np.ndarray:
    """Each byte's symbol in each alphabet, 255 where it has none."""
    out = np.full((len(ALPHABETS), 256), 255, np.uint8)
    for row, alphabet in zip(out, ALPHABETS, strict=True):
        row[list(alphabet.encode())] = np.arange(len(alphabet))
    out[0, list(b"ABCDEF")] = np.arange(10, 16)
    out[3, list(b"-_=")] = (62, 63, 0)
    out[1, list(b"=")] = 0
    return out


SYMBOLS = _tables()


def scores(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoding of each string between the bounds, and how many standard deviations it is from random."""
    n_rows, starts, n = len(bounds) - 1, bounds[:-1], np.diff(bounds).astype(np.float64)
    if not n_rows:
        return np.zeros(0, np.int64), np.zeros(0)
    owner = text.row_of(bounds)
    encoding = np.full(n_rows, len(ALPHABETS) - 1)
    for i in reversed(range(len(ALPHABETS) - 1)):
        encoding[~np.logical_or.reduceat(SYMBOLS[i][data] == 255, starts)] = i
    size = SIZES[encoding].astype(np.float64)
    symbol = SYMBOLS[encoding[owner], data].astype(np.int64)
    square = np.zeros(n_rows)
    for low in range(0, n_rows, 16384):
        high = min(n_rows, low + 16384)
        part = slice(bounds[low], bounds[high])
        count = np.bincount((owner[part] - low) * 64 + symbol[part], minlength=(high - low) * 64).reshape(-1, 64)
        square[low:high] = (count.astype(np.float64) ** 2).sum(1)
    free = size - 1
    chi = (square * size / n - n) / free
    uniform = (np.cbrt(np.maximum(chi, 0)) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))
    above = 2 * symbol >= size[owner]
    inner = np.ones(len(data), bool)
    inner[starts] = False
    turns = np.zeros(len(data))
    turns[1:] = above[1:] != above[:-1]
    turns *= inner
    n1 = np.add.reduceat(above.astype(np.float64), starts)
    expected = 2 * n1 * (n - n1) / n
    spread_ = np.sqrt(np.maximum(expected * np.maximum(expected - 1, 0) / np.maximum(n - 1, 1), 1e-9))
    runs = np.where((n1 > 0) & (n1 < n), np.abs(np.add.reduceat(turns, starts) - expected) / spread_, np.sqrt(n))
    value = symbol - (np.add.reduceat(symbol, starts) / n)[owner]
    lag = np.zeros(len(data))
    lag[1:] = value[1:] * value[:-1]
    lag *= inner
    power = np.add.reduceat(value * value, starts)
    serial = np.abs(np.add.reduceat(lag, starts)) / np.maximum(power, 1e-9) * np.sqrt(n)
    serial = np.where(power > 1e-9, serial, np.sqrt(n))
    return encoding, np.maximum(np.maximum(uniform, runs), serial)


def _cell(encoding: np.ndarray, length: np.ndarray, score: np.ndarray) -> np.ndarray:
    group = encoding * len(CLASSES) + np.searchsorted(CLASSES, length, "right") - 1
    return group * SCORES + np.clip(score / STEP, 0, SCORES - 1).astype(np.int64)


def _tokens(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, _ = text.runs(TOKEN[buf], offsets)
    long = ends - starts >= SHORTEST
    return starts, ends, long


def _gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = ends - starts
    bounds = np.append(0, np.cumsum(size))
    return buf[np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _varied(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which strings have three different bytes at least."""
    starts = bounds[:-1]
    if not len(starts):
        return np.zeros(0, bool)
    owner, low, high = text.row_of(bounds), np.minimum.reduceat(data, starts), np.maximum.reduceat(data, starts)
    return np.bincount(owner[(data != low[owner]) & (data != high[owner])], minlength=len(starts)) > 0


def _tail(ordinary: np.ndarray, strings: float) -> np.ndarray:
    """Share of ordinary strings with at most each score cell; where few have so little, as the fitted exponential goes on."""
    p = (ordinary + 1) / (strings + 1)
    known = np.flatnonzero(ordinary >= FEW)
    if not len(known) or not strings:
        return p
    first = known[0]
    later = known[ordinary[known] >= FEW * FEW]
    if len(later) and later[0] > first:
        slope = max(np.log(ordinary[later[0]] / ordinary[first]) / (later[0] - first), 0.0)
        below = np.arange(first)
        p[:first] = np.minimum(p[:first], ordinary[first] / strings * np.exp(-slope * (first - below)))
    return p


def cutoffs(docs: DataFrame, rate: float = RATE) -> np.ndarray:
    """The highest score cell, per encoding and length class, that still counts as random; -1 for none."""

    def count(batches):
        cells = len(ALPHABETS) * len(CLASSES) * SCORES
        total, found = np.zeros(cells, np.int64), []
        for batch in batches:
            for part in text.slices(batch, limit=1 << 20):
                buf, offsets = text.utf8(part.column("text"))
                starts, ends, long = _tokens(buf, offsets)
                data, bounds = _gather(buf, starts[long], ends[long])
                encoding, score = scores(data, bounds)
                varied = _varied(data, bounds)
                found.append(np.unique(np.stack([_cell(encoding, np.diff(bounds), score)[varied], text.range_hashes(data, bounds[:-1][varied], bounds[1:][varied]).view(np.int64)], 1), axis=0))
                data, _ = _gather(buf, starts[~long], ends[~long])
                sizes = np.tile(PIECES, len(data) // int(PIECES.sum()) + 1)
                bounds = np.append(0, np.cumsum(sizes))
                bounds = bounds[bounds <= len(data)]
                encoding, score = scores(data[: bounds[-1]], bounds)
                total += np.bincount(_cell(encoding, np.diff(bounds), score), minlength=cells)
                if sum(map(len, found)) > 1 << 16:
                    yield from told(found)
                    found = []
        yield from told(found)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.nulls(len(at), pa.int64())], names=["cell", "ordinary", "string"])

    def told(found):
        if found:
            each = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(np.zeros(len(each), np.int64)), pa.array(each[:, 1])], names=["cell", "ordinary", "string"])

    # one row a cell and string, then one a cell
    strings = docs.select("text").mapInArrow(count, "cell long, ordinary long, string long").groupBy("cell", "string").agg(F.sum("ordinary").alias("ordinary"))
    counted = strings.groupBy("cell").agg(F.sum("ordinary").alias("ordinary"), F.count("string").alias("found"))
    table = np.zeros((2, len(ALPHABETS), len(CLASSES), SCORES))
    for x in counted.toLocalIterator():
        table[:, *np.unravel_index(x["cell"], table.shape[1:])] = x["ordinary"], x["found"]
    ordinary, found = table.cumsum(-1)
    strings = table[0].sum((0, 2))[None, :, None]
    p = np.array([[_tail(ordinary[i, j], strings[0, j, 0]) for j in range(len(CLASSES))] for i in range(len(ALPHABETS))])
    tests = table[1].sum((0, 2))[None, :, None]  # all candidates of that length, whatever their encoding
    good = (p * tests <= rate * found) & (found > 0)
    return np.where(good.any(-1), np.minimum(SCORES - 1 - np.argmax(good[..., ::-1], -1), int(ACCEPT / STEP)), -1)


def base_spans(string: str, buf: np.ndarray | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the assign and access patterns."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(string) if len(m[2]) >= LEAST["assign"]]
    return out + [(m.start(), "access", m.end()) for m in ACCESS.finditer(string) if len(m[0]) >= LEAST["access"]]


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, spans as array<struct<kind, start, stop>> of every document row, in order."""
    own = spread.slim(docs).select("doc_id", "text")
    cut = cutoffs(own, rate).reshape(-1)

    def rows(batches):
        for batch in batches:
            for part in text.slices(batch):
                column = part.column("text")
                buf, offsets = text.utf8(column)
                spans: list[list] = [[] for _ in range(part.num_rows)]
                likely = pc.or_(pc.match_substring_regex(column, "(?i)(password|passwd|secret|token|api_?key)"), pc.match_substring(column, "AKIA"))
                for i in np.flatnonzero(likely.to_numpy(zero_copy_only=False)):
                    spans[i] += base_spans(column[i].as_py())
                later = np.append(0, np.cumsum((buf & 0xC0) == 0x80))
                starts, ends, rows_ = text.runs(HEX[buf], offsets)
                long = np.flatnonzero(ends - starts >= LEAST["hex"])
                for s, e in zip(starts[long], ends[long], strict=True):
                    i = int(np.searchsorted(offsets, s, "right")) - 1
                    shift = offsets[i] + later[s] - later[offsets[i]]
                    spans[i].append((int(s - shift), "hex", int(e - shift)))
                starts, ends, long = _tokens(buf, offsets)
                starts, ends = starts[long], ends[long]
                data, bounds = _gather(buf, starts, ends)
                cell = _cell(*(lambda found: (found[0], np.diff(bounds), found[1]))(scores(data, bounds)))
                taken = {}
                for j in np.flatnonzero(cell % SCORES <= cut[cell // SCORES]) if len(cell) else ():
                    i = int(np.searchsorted(offsets, starts[j], "right")) - 1
                    shift = offsets[i] + later[starts[j]] - later[offsets[i]]
                    s, e = int(starts[j] - shift), int(ends[j] - shift)
                    if i not in taken:
                        taken[i] = _merged(spans[i])
                    if _free(s, e, *taken[i]):  # tokens themselves never overlap
                        spans[i].append((s, "random", e))
                out = [[{"kind": k, "start": a, "stop": b} for a, k, b in sorted(x, key=lambda x: (x[0], KINDS.index(x[1])))] for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "spans"])

    return own.mapInArrow(rows, "doc_id long, spans array<struct<kind:string,start:int,stop:int>>")


def _merged(spans: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and apart from each other."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(start: int, stop: int, starts: list[int], ends: list[int]) -> bool:
    """Whether nothing of what is covered lies between start and stop."""
    at = bisect.bisect_right(ends, start)
    return at == len(ends) or starts[at] >= stop


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
