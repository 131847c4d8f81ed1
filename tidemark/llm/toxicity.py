"""Toxicity by subword-bag embeddings averaged into a linear softmax (op6).

A word (A-Z lower-cased; digits, letters and non-ASCII characters) is the bag of the hashed 3- to 5-grams of
its bytes with end marks, and of itself; its vector is the mean of theirs, and a segment of
``SEGMENT`` words, half overlapping the next, averages its words'. A linear softmax over two classes scores segments; a
document is as toxic as its most toxic segment and its most toxic words, so that one word in a long text isn't averaged away.
Embeddings and softmax are trained together in numpy by Adam, first on all segments, then on each
document's top one. Grams of few texts get no vector and squared embeddings are penalised, so that what is learned is
what many texts share, not the words of each. A part of the learned rows that is first kept out says how many rounds to take
and calibrates the document scores by a logistic map from the top segment's logit, the mean logit of the highest words and the log of
the number of words. As the softmax is linear, a word's
part of the score is a scalar, computed once for each distinct word of a slice.

Fitting takes at most ``SAMPLE`` labelled documents of each class (least hashes of doc_id first), none of which is
held out: crc32 of the doc_id's text modulo 5 is 0 for those. Labels, lang, source and doc_id are no inputs.
Every whole text is scored. Defined cases: a null or empty text gets the base rate's
score; without labels of both classes every score is the base rate (0 if there are none); a null doc_id is
held out (the CRC of nothing is 0); of contradicting labels the larger counts, of several texts of a labelled doc_id the one
of the least hash; of equally toxic segments the first counts; very long texts are whole; an empty table gives no rows;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spread, text
from tidemark.llm.decontaminate import WORD

SAMPLE = 1500
BUCKETS, DIM, SEGMENT, GRAMS = 1 << 18, 8, 8, (3, 4, 5)
WARM, ROUNDS, STEPS, STEP = 30, 12, 8, 0.05
#: Weight of the squared embeddings in the loss, texts that a bucket must occur in, rounds without a gain.
PENALTY, COMMON, PATIENCE = 1e-5, 3, 3
#: Words whose mean logit stands beside the top segment's.
HIGHEST = 3
#: Weight of the squared weights that calibrate these.
RIDGE = 0.1


def _bags(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, and offsets: the grams of words with a mark at either end."""
    size = ends - starts + 2
    bounds = np.append(0, np.cumsum(size))
    padded = np.full(bounds[-1], 0x3C, np.uint8)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = False
    inner[bounds[1:] - 1] = False
    padded[bounds[1:] - 1] = 0x3E
    source = bounds[:-1] + 1
    padded[inner] = buf[np.repeat(starts - source, size - 2) + np.flatnonzero(inner)] if inner.any() else padded[inner]
    hashes, owners = [text.byte_hashes(padded, bounds[:-1], bounds[1:], 11)], [np.arange(len(starts))]
    row = text.row_of(bounds)
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(padded)) + n <= bounds[1:][row])
        hashes.append(text.byte_hashes(padded, at, at + n, 11))
        owners.append(row[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(hashes)[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(starts) + 1))


def _words(column):
    """Index of each word among the distinct ones, row offsets, and the distinct words' bags."""
    buf, offsets = text.utf8(column)
    buf = text.LOWER[buf]
    starts, ends, rows = text.runs(WORD[buf], offsets)
    _, first, which = np.unique(text.byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    return which, rows, *_bags(buf, starts[first], ends[first])


def _joined(texts: list[str]):
    """The same for texts of any size: slice by slice, each with distinct words of its own."""
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    which, rows, bags, ends, known = [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], 0
    for part in text.slices(whole):
        w, r, bag, at = _words(part.column("text"))
        which.append(w + known)
        known += len(at) - 1
        rows.append(r[1:] + rows[-1][-1])
        bags.append(bag.astype(np.int32))
        ends.append(at[1:] + ends[-1][-1])
    return np.concatenate(which), np.concatenate(rows), np.concatenate(bags), np.concatenate(ends)


def _mean(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean between bounds; 0 where there is nothing."""
    sums = np.append(0, np.cumsum(values))
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def _segments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each segment, and offsets of each row's; a row without words has none."""
    n = np.diff(rows)
    half = SEGMENT // 2
    count = np.where(n > 0, 1 + np.maximum(-(-(n - SEGMENT) // half), 0), 0)
    bounds = np.append(0, np.cumsum(count))
    start = np.repeat(rows[:-1] - half * bounds[:-1], count) + half * np.arange(bounds[-1])
    return start, np.minimum(start + SEGMENT, np.repeat(rows[1:], count)), bounds


class Model:
    def __init__(self, base: float):
        self.base, self.theta, self.bias, self.weights, self.shift = base, None, 0.0, np.zeros(3), 0.0

    def evidence(self, column) -> np.ndarray:
        """What the score of each text is made of, NaN for those without words."""
        which, rows, bag, at = _words(column)
        return _evidence(_mean(self.theta[bag], at)[which], rows, self.bias)

    def score(self, column) -> np.ndarray:
        if self.theta is None:
            return np.full(len(column), self.base)
        z = self.evidence(column) @ self.weights + self.shift
        return np.where(np.isnan(z), self.base, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _evidence(words: np.ndarray, rows: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each row's top segment, mean logit of its ``HIGHEST`` words, and log of its number of words, by which a maximum grows; NaN without words."""
    n = np.diff(rows)
    order = np.lexsort((-words, text.row_of(rows)))
    at = rows[:-1, None] + np.arange(HIGHEST)
    there = at < rows[1:, None]
    high = np.where(there, words[order[np.minimum(at, max(len(words) - 1, 0))]] if len(words) else 0.0, 0.0).sum(1) / np.maximum(there.sum(1), 1)
    out = np.stack([_top(words, rows)[0] + bias, high + bias, np.log(np.maximum(n, 1))], 1)
    out[n == 0] = np.nan
    return out


def _top(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, first and last word of each row's highest segment; NaN and nothing for a row without words."""
    start, stop, bounds = _segments(rows)
    sums = np.append(0, np.cumsum(words))
    value = (sums[stop] - sums[start]) / (stop - start)
    best = np.full(len(rows) - 1, np.nan)
    low, high = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        best[full] = np.maximum.reduceat(value, bounds[full])
        owner = text.row_of(bounds)
        hit = np.flatnonzero(value == best[owner])
        first = hit[np.unique(owner[hit], return_index=True)[1]]
        low[full], high[full] = start[first], stop[first]
    return best, low, high


def gradients(table: np.ndarray, out: np.ndarray, bias: np.ndarray, data, labels: np.ndarray, share: np.ndarray, spans, learned: np.ndarray):
    """Loss of the joint model over segments, and its gradients by embeddings, softmax and bias.

    ``spans`` are first word, last word and row of each segment; those of a row share its weight. Embeddings that aren't ``learned`` stay 0."""
    which, _, bag, at = data
    low, high, owner = spans
    direction, size = out[:, 1] - out[:, 0], high - low
    sums = np.append(0, np.cumsum(_mean((table @ direction.astype(table.dtype))[bag].astype(np.float64), at)[which]))
    z = np.clip((sums[high] - sums[low]) / size + bias[1] - bias[0], -30, 30)
    weight = share[owner] / np.bincount(owner, minlength=len(labels))[owner]
    loss = float(weight @ (np.logaddexp(0, z) - labels[owner] * z)) + PENALTY / 2 * float(np.sum(table.astype(np.float64) ** 2))
    d = (1 / (1 + np.exp(-z)) - labels[owner]) * weight
    edge = np.bincount(low, d / size, len(which) + 1) - np.bincount(high, d / size, len(which) + 1)
    by_word = np.bincount(which, np.cumsum(edge[:-1]), len(at) - 1)
    by_gram = np.bincount(bag, np.repeat(by_word / np.maximum(np.diff(at), 1), np.diff(at)), len(table)) * learned
    half = by_gram @ table
    return loss, ((by_gram[:, None] * direction).astype(table.dtype) + table.dtype.type(PENALTY) * table, np.stack([-half, half], 1), np.array([-d.sum(), d.sum()]))


def _common(data, use: np.ndarray) -> np.ndarray:
    """Which buckets occur in ``COMMON`` of the used rows or more."""
    which, rows, bag, at = data
    seen = np.zeros(BUCKETS, np.int32)
    for i in np.flatnonzero(use):
        words = np.unique(which[rows[i] : rows[i + 1]])
        size = at[words + 1] - at[words]
        seen[np.unique(bag[np.repeat(at[words] - np.cumsum(size) + size, size) + np.arange(size.sum())])] += 1
    return seen >= COMMON


def _rounds(data, labels: np.ndarray, use: np.ndarray, seed: int):
    """Learns from the used rows; (scalar of each bucket, bias) after each round, the first of which takes all segments."""
    rng = np.random.default_rng(seed)
    slots, (which, rows, bag, at) = np.flatnonzero(_common(data, use)), data
    # a table of the learned buckets only; all others share its last row, which stays 0
    place = np.full(BUCKETS, len(slots), np.int32)
    place[slots] = np.arange(len(slots))
    data, learned = (which, rows, place[bag], at), np.arange(len(slots) + 1) < len(slots)
    table = np.append(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)[slots], np.zeros((1, DIM), np.float32), 0)
    out, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, out, bias)]
    share = use * np.where(labels > 0, 0.5 / max((use * labels).sum(), 1), 0.5 / max((use * (1 - labels)).sum(), 1))
    start, stop, bounds = _segments(rows)
    owner = text.row_of(bounds)
    mine = use[owner]
    spans, t = (start[mine], stop[mine], owner[mine]), 0
    for number in range(ROUNDS + 1):
        for _ in range(STEPS if number else WARM):
            t += 1
            _, grads = gradients(table, out, bias, data, labels, share, spans, learned)
            for p, g, (m, v) in zip((table, out, bias), grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        scalars, theta = table @ (out[:, 1] - out[:, 0]), np.zeros(BUCKETS)
        theta[slots] = scalars[:-1]
        yield theta, float(bias[1] - bias[0])
        _, low, high = _top(_mean(scalars[data[2]], at)[which], rows)
        full = np.flatnonzero((high > low) & use)
        spans = (low[full], high[full], full)


def train(texts: list[str], labels: np.ndarray, rate: float, seed: int = 7) -> Model:
    """Fits on texts with 0/1 labels; ``rate`` is the share of label 1 that scores are calibrated to.

    A fifth of each class is first kept out: by its loss the number of rounds is chosen and the scores are calibrated. Then all texts are learned from."""
    model = Model(rate)
    labels = np.asarray(labels, np.float64)
    if not 0 < labels.sum() < len(labels):
        return model
    data = _joined(texts)
    use, rng = np.ones(len(labels), bool), np.random.default_rng(seed + 1)
    for value in (0, 1):
        part = np.flatnonzero(labels == value)
        use[rng.permutation(part)[: len(part) // 5]] = False
    part = ~use
    chosen, best, maps = ROUNDS, np.inf, None
    if 0 < labels[part].sum() < part.sum():
        for number, (theta, bias) in enumerate(_rounds(data, labels, use, seed)):
            x = _evidence(_mean(theta[data[2]], data[3])[data[0]], data[1], bias)
            known = part & ~np.isnan(x[:, 0])
            found = combine(x[known], labels[known], rate, RIDGE)
            loss = _loss(x[known] @ found[0] + found[1], labels[known], rate)
            if loss < best:
                chosen, best, maps = number, loss, found
            elif number - chosen >= PATIENCE:
                break
    for number, (model.theta, model.bias) in enumerate(_rounds(data, labels, np.ones(len(labels), bool), seed)):
        if number == chosen:
            break
    if maps is None:
        x = _evidence(_mean(model.theta[data[2]], data[3])[data[0]], data[1], model.bias)
        known = ~np.isnan(x[:, 0])
        maps = combine(x[known], labels[known], rate, RIDGE)
    model.weights, model.shift = maps
    return model


def _loss(z: np.ndarray, y: np.ndarray, rate: float) -> float:
    """Mean logistic loss with classes weighted to ``rate``."""
    weight = np.where(y > 0, rate / max(y.sum(), 1), (1 - rate) / max((1 - y).sum(), 1))
    return float(weight @ (np.logaddexp(0, z) - y * z))


def calibrate(z: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope and intercept of a logistic map from logits, as ``combine``."""
    (slope,), shift = combine(z[:, None], y, rate)
    return slope, shift


def combine(x: np.ndarray, y: np.ndarray, rate: float, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic map from columns, with classes weighted to ``rate`` and softened targets."""
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, rate / pos, (1 - rate) / neg) * len(y)
    center, width = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack([(x - center) / width, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    slopes = w[:-1] / width
    return slopes, float(w[-1] - slopes @ center)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on the driver, on at most ``sample`` documents of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = {x.toxic: x.n for x in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = spread.slim(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("th", "text", "toxic"), "th").alias("x")).select("doc_id", "x.*")
    rows = sorted(((x.doc_id, x.th, x.text, x.toxic) for x in texts.toLocalIterator()), key=lambda x: x[:2])
    return train([x[2] for x in rows], np.array([x[3] for x in rows]), rate)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with their score as one more column, of that name or, where they have it, the next free one."""
    (column,) = spread.free_names(docs, column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array(np.concatenate([shared.value.score(part.column("text")) for part in text.slices(batch)] or [np.zeros(0)]))

    return docs.withColumn(column, score(F.coalesce("text", F.lit(""))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
