"""Language identification by error-correcting output codes (op11).

Each language has a codeword of bits; each bit has a binary classifier, a logistic regression on hashed n-grams of 1 to 4 bytes of the
words (letters, digits and non-ASCII characters, lower-cased, with end marks) and on whole words. Up to five languages get the exhaustive
code, more of them the best of ``DRAWS`` random codes by least distance. Loss-weighted decoding: the logistic losses of the bits against
a codeword are summed with each language's weights, the shares of its documents that a bit's classifier got right on
documents it did not learn from; the least sum wins. A document is ambiguous if its bits are further from its codeword than the code corrects
or the score, the softmax of the scaled losses, is below ``SURE``.

Fitting: the ``LANGS`` most frequent values of lang are learned, from about ``SAMPLE`` documents of each (those of the least hashes of
doc_id and text; of equal rows one), none of which is held out: crc32 of the doc_id's text modulo 5 is 0 for those. Only counts of hashed
n-grams reach the driver, at most ``BUCKETS`` for each of them. lang, source and doc_id are no inputs of a prediction.

Every whole text is scored. Defined cases: a text that is null or has no letter is ``und`` with score 0 and not ambiguous, and not learned from; a null
lang is not learned from; a null doc_id is held out (the CRC of nothing is 0); if nothing can be learned all is ``und``, if one language, all
texts with a letter are of it with score 1; of equal losses the first language by name wins; equal rows have equal results; very long texts are
whole; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spread, text
from tidemark.llm.decontaminate import WORD
from tidemark.llm.toxicity import held_out

SAMPLE, LANGS = 1000, 256
#: Sampled documents of all languages together.
TOTAL = 24_000
BUCKETS, GRAMS = 1 << 17, (1, 2, 3, 4)
EPOCHS, BATCH, STEP, DECAY = 6, 64, 0.5, 1e-5
DRAWS, SURE = 200, 0.6
#: Every so many-th sampled document weighs the bits and scales the scores instead of being learned from.
ASIDE = 4
UNKNOWN = "und"


def code(n: int, seed: int = 17) -> np.ndarray:
    """Codewords of n languages, of +1 and -1: no two columns are equal or opposite, none is constant."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        rows = [[(column >> (n - 1 - i)) & 1 for column in range(1 << n - 1, (1 << n) - 1)] for i in range(n)]
        return 1.0 - 2.0 * np.array(rows)
    bits, rng, best, distance = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(DRAWS):
        drawn = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        drawn *= drawn[:1]  # opposite columns become equal
        drawn = np.unique(drawn, axis=1)
        drawn = drawn[:, (drawn != drawn[:1]).any(0)]
        apart = least_distance(drawn)
        if apart > distance:
            best, distance = drawn, apart
    return best


def least_distance(codes: np.ndarray) -> int:
    """Least number of bits in which two codewords differ."""
    agree = codes @ codes.T
    np.fill_diagonal(agree, -np.inf)
    return int((codes.shape[1] - agree.max()) // 2) if len(codes) > 1 else 0


def _words(column):
    """Index of each word among the distinct ones, row offsets, and the distinct words' n-grams."""
    buf, offsets = text.utf8(pc.utf8_lower(column))
    starts, ends, rows = text.runs(WORD[buf], offsets)
    _, first, which = np.unique(text.byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    return which, rows, *text.word_bags(buf, starts[first], ends[first], GRAMS, BUCKETS, 23)


def gram_counts(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-gram buckets of each text and their counts."""
    which, rows, bag, at = _words(column)
    out = []
    for low, high in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        word, times = np.unique(which[low:high], return_counts=True)
        size = at[word + 1] - at[word]
        inner = np.repeat(at[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found, place = np.unique(bag[inner], return_inverse=True)
        out.append((found.astype(np.int32), np.bincount(place, np.repeat(times, size), len(found)).astype(np.int32)))
    return out


class Model:
    """Languages, their codewords, and the classifiers of the bits."""

    def __init__(self, langs: list[str]):
        self.langs, self.code = langs, code(len(langs))
        bits = self.code.shape[1]
        self.table, self.bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits)
        self.weights, self.scale = np.full(self.code.shape, 1 / max(bits, 1)), 1.0

    def margins(self, column) -> np.ndarray:
        """Each text's value for each bit: the mean over its n-grams."""
        which, rows, bag, at = _words(column)
        size = np.diff(at)
        out = np.empty((len(column), self.code.shape[1]))
        total = _between(size[which], rows)
        for b in range(self.code.shape[1]):
            word = _between(self.table[:, b][bag], at)
            out[:, b] = _between(word[which], rows) / np.maximum(total, 1) + self.bias[b]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic losses of each text against each codeword."""
        right, wrong = np.logaddexp(0, -margins), np.logaddexp(0, margins)
        return right @ (self.weights * (self.code > 0)).T + wrong @ (self.weights * (self.code < 0)).T

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        loss = self.losses(margins)
        best = loss.argmin(1)
        score = 1 / np.exp(-self.scale * (loss - loss.min(1, keepdims=True))).sum(1)
        wrong = (np.where(margins >= 0, 1, -1) != self.code[best]).sum(1)
        return best, score, (score < SURE) | (wrong > max(least_distance(self.code) - 1, 0) // 2)


def _between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model:
    """Fits to (language, n-gram buckets, counts) of documents in any order."""
    model = Model(sorted({x[0] for x in rows}))
    if len(model.langs) < 2:
        return model
    place = {x: i for i, x in enumerate(model.langs)}
    lang = np.array([place[x[0]] for x in rows])
    order = np.argsort(lang, kind="stable")
    number = np.empty(len(rows), np.int64)
    number[order] = np.arange(len(rows)) - np.searchsorted(lang[order], lang[order])  # within its language
    aside = number % ASIDE == ASIDE - 1
    balance = len(rows) / len(model.langs) / np.bincount(lang)
    rng, seen = np.random.default_rng(seed), np.full(model.table.shape, 1e-8, np.float32)
    learn, bias_seen = np.flatnonzero(~aside), np.full(len(model.bias), 1e-8)

    def margin(some):
        """Their n-grams, the share of each, their row, and the bits' values."""
        grams = np.concatenate([rows[i][1] for i in some])
        share = np.concatenate([rows[i][2] / max(rows[i][2].sum(), 1) for i in some]).astype(np.float32)
        owner = np.repeat(np.arange(len(some)), [len(rows[i][1]) for i in some])
        value = np.stack([np.bincount(owner, model.table[grams, b] * share, len(some)) for b in range(len(model.bias))], 1)
        return grams, share, owner, value + model.bias

    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for low in range(0, len(learn), BATCH):
            some = learn[low : low + BATCH]
            grams, share, owner, value = margin(some)
            target = model.code[lang[some]]
            slope = -target / (1 + np.exp(np.clip(target * value, -30, 30))) * balance[lang[some]][:, None] / len(some)
            known, at = np.unique(grams, return_inverse=True)
            for b in range(len(model.bias)):  # AdaGrad: rare n-grams learn as fast as frequent ones
                g = np.bincount(at, slope[owner, b] * share, len(known)).astype(np.float32) + DECAY * model.table[known, b]
                seen[known, b] += g * g
                model.table[known, b] -= STEP * g / np.sqrt(seen[known, b])
            g = slope.sum(0)
            bias_seen += g * g
            model.bias -= 0.1 * STEP * g / np.sqrt(bias_seen)
    test = np.flatnonzero(aside)
    if len(test):
        value = np.concatenate([margin(test[low : low + BATCH])[3] for low in range(0, len(test), BATCH)])
        model.weights, model.scale = weigh(model, value, lang[test])
    return model


def weigh(model: Model, value: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, float]:
    """Each language's weights of the bits, its shares of right bits scaled to sum 1, and the scale of losses under which the true languages are likeliest."""
    right = (np.where(value >= 0, 1, -1) == model.code[lang]).astype(float)
    count = np.bincount(lang, minlength=len(model.langs))
    share = np.stack([np.bincount(lang, right[:, b], len(count)) for b in range(right.shape[1])], 1)
    share = (share + 1) / (count[:, None] + 2)
    model.weights = share / share.sum(1, keepdims=True)
    loss = model.losses(value)
    loss -= loss.min(1, keepdims=True)
    scales = 2.0 ** np.arange(0, 7)
    likely = [(-s * loss[np.arange(len(lang)), lang] - np.log(np.exp(-s * loss).sum(1))).mean() for s in scales]
    return model.weights, float(scales[int(np.argmax(likely))])


def learnable() -> F.Column:
    """Rows that may be learned from."""
    return F.col("lang").isNotNull() & ~held_out() & lettered()


def lettered() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, langs: int = LANGS) -> Model:
    """Trains on about ``sample`` documents of each of the ``langs`` most frequent languages, at most ``TOTAL`` in all."""
    known = docs.where(learnable()).select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text", spread.text_key().alias("th"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    if not counts:
        return train([])
    each = min(sample, max(TOTAL // len(counts), ASIDE))
    share = F.element_at(F.create_map(*[F.lit(x) for c in counts for x in (c["lang"], min(1.0, each / c["n"]))]), F.col("lang"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id", "th"), 11) / F.lit(float(1 << 53))

    def count(batches):
        for batch in batches:
            for part in text.slices(batch):
                found = gram_counts(part.column("text"))
                grams, times = (pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("doc_id"), part.column("th"), grams, times], names=["lang", "doc_id", "th", "grams", "times"])

    drawn = known.where(uniform < share).dropDuplicates(["lang", "doc_id", "th"]).select("lang", "doc_id", "th", "text")
    rows = drawn.mapInArrow(count, "lang string, doc_id long, th long, grams binary, times binary").collect()
    rows.sort(key=lambda x: (x["lang"], x["th"], x["doc_id"] is None, x["doc_id"] or 0))
    return train([(x["lang"], np.frombuffer(x["grams"], np.int32), np.frombuffer(x["times"], np.int32)) for x in rows])


def identified(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """The documents with a struct (lang_pred, score, ambiguous) as one more column, of that name or, where they have it, the next free one."""
    (column,) = spread.free_names(docs, column)
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if len(model.langs) < 2:
        only = F.struct(F.lit(model.langs[0]).alias("lang_pred"), F.lit(1.0).alias("score"), F.lit(False).alias("ambiguous")) if model.langs else none
        return docs.withColumn(column, F.when(lettered(), only).otherwise(none))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def identify(texts: pa.Array) -> pa.Array:
        model = shared.value
        parts = [model.margins(part.column("text")) for part in text.slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        best, score, unsure = model.decode(np.concatenate(parts) if parts else np.zeros((0, model.code.shape[1])))
        return pa.StructArray.from_arrays([pa.array(model.langs, pa.string()).take(pa.array(best)), pa.array(score), pa.array(unsure)], names=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(column, F.when(lettered(), identify(F.coalesce("text", F.lit("")))).otherwise(none))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")
