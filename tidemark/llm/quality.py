"""Quality classifier by co-training two views (op8).

The text view has shares of symbols, capitals, digits and bars, word lengths, and how many words are
distinct or repeat the one before; the page-metadata view has source, lang and the stated
number of characters. A logistic regression is fitted to each view. In every round each view
labels the documents without a label that it is most sure of, of all there are, for the other view to
learn from. On a part of the labelled sample that neither has seen, each view's logit is
calibrated and a last regression weighs the two; a view that knows nothing gets no weight.

Fitting takes at most ``SAMPLE`` labelled documents (least hashes of doc_id first) and, a round, ``MOVED`` pseudo-labels of each
view and class: of these, only features reach the driver. All documents are scored from whole texts. Defined cases: a null
or empty text has features of its own (nothing of anything); nulls in source, lang or n_chars are a value of their own;
without labels of both classes all score the base rate (1 if there are none); a null doc_id
is scored; of contradicting labels the smaller counts; of equally sure documents the least doc_id, then text hash, comes first;
very long texts are whole; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spread, text
from tidemark.llm.toxicity import calibrate

SAMPLE = 8000
ROUNDS, MOVED, SURE = 5, 200, 0.95
HASHED = 32
_UPPER = text.byte_class((0x41, 0x5A))
_DIGIT = text.byte_class((0x30, 0x39))
_SYMBOL = text.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_PLAIN = text.byte_class(*((ord(c), ord(c)) for c in ".,;:'\"-()?"))
_BAR = text.byte_class((0x7C, 0x7C))


def text_view(column: pa.Array) -> np.ndarray:
    """Features of each whole text."""
    parts = []
    for part in text.slices(pa.RecordBatch.from_arrays([column], names=["text"])):
        buf, offsets = text.utf8(part.column("text"))
        starts, ends, rows = text.runs(text.NON_SPACE[buf], offsets)
        words, row = text.byte_hashes(buf, starts, ends), text.row_of(rows)
        n, size = np.maximum(np.diff(rows), 1), np.maximum(np.diff(offsets), 1)

        def share(mask, offsets=offsets, size=size):
            sums = np.append(0, np.cumsum(mask))
            return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

        order = np.lexsort((words, row))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=part.num_rows) / n
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[again], minlength=part.num_rows) / n
        odd = share((_SYMBOL & ~_PLAIN)[buf])
        parts.append(np.stack([np.log(odd + 0.005), np.log(share(_UPPER[buf]) + 0.02), np.log(again + 0.05), distinct, np.log(share(_BAR[buf]) + 0.005), share(_DIGIT[buf]), np.log(size / n), np.log(n + 1.0), share((_SYMBOL & _PLAIN)[buf])], 1))
    return np.concatenate(parts) if parts else np.zeros((0, 9))


def meta_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed one-hot source and lang, and the stated size."""
    out = np.zeros((len(source), 2 * HASHED + 3))
    for i, column in enumerate((source, lang)):
        buf, offsets = text.utf8(column.fill_null("\x00"))
        slot = text.byte_hashes(buf, offsets[:-1], offsets[1:], 3 + i) % np.uint64(HASHED)
        out[np.arange(len(column)), i * HASHED + slot.astype(np.int64)] = 1
    known = n_chars.is_valid().to_numpy(zero_copy_only=False)
    size = np.log1p(np.maximum(np.asarray(n_chars.cast(pa.float64()).fill_null(0.0)), 0))
    out[:, -3], out[:, -2], out[:, -1] = size, size * size / 10, ~known
    return out


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hessian = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge)
            move = np.linalg.solve(hessian, z.T @ (p - y) + ridge * self.w)
            self.w -= move
            if np.abs(move).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.std, -8, 8), np.ones((len(x), 1))], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w


class Model:
    def __init__(self, base: float):
        self.base, self.views = base, None

    def combined(self, views: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.stack([a * v.logit(x) + b for v, x, (a, b) in zip(self.views, views, self.scales, strict=True)], 1)

    def score(self, views: tuple[np.ndarray, ...]) -> np.ndarray:
        if self.views is None:
            return np.full(len(views[0]), self.base)
        return 1 / (1 + np.exp(-np.clip(self.last.logit(self.combined(views)), -30, 30)))


def halves(y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Three quarters of the labelled rows to fit on and the rest to calibrate on."""
    order = np.random.default_rng(seed).permutation(len(y))
    return order[len(order) // 4 :], order[: len(order) // 4]


def co_train(views: tuple[np.ndarray, ...], y: np.ndarray, surest: Callable) -> Model:
    """``surest`` gets the round and both views' models, and gives (view, label, features of the other view) of pseudo-labels."""
    model = Model(float(y.mean()) if len(y) else 1.0)
    fit, rest = halves(y)
    if not 0 < y[fit].sum() < len(fit) or not 0 < y[rest].sum() < len(rest):
        return model
    xs, ys = [v[fit] for v in views], [y[fit].astype(float) for _ in views]
    for turn in range(ROUNDS):
        for view, label, x in surest(turn, [Logistic(x, t) for x, t in zip(xs, ys, strict=True)]):
            other = 1 - view
            xs[other], ys[other] = np.concatenate([xs[other], x]), np.concatenate([ys[other], np.full(len(x), label)])
    model.views = [Logistic(x, t) for x, t in zip(xs, ys, strict=True)]
    seen = tuple(v[rest] for v in views)
    model.scales = [calibrate(v.logit(x), y[rest], float(y.mean())) for v, x in zip(model.views, seen, strict=True)]
    model.last = Logistic(model.combined(seen), y[rest].astype(float), 0.1)
    return model


def _metadata(docs: DataFrame) -> list:
    """source, lang and n_chars, as null where a table lacks one."""
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]


WIDTH = 9
_FEATURES = "doc_id long, th long, quality int, x array<double>, source string, lang string, n_chars double"


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(batch.column("x").flatten()).reshape(-1, WIDTH)
    return x, meta_view(batch.column("source"), batch.column("lang"), batch.column("n_chars"))


def featured(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Text features and metadata of the labelled sample (quality 0 or 1) and of every document without a label (-1), stored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("used", F.lit(True))
    marks = spread.stored(known.join(chosen.select("doc_id", "used"), "doc_id", "left"), "marks")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), spread.text_key().alias("th"), *_metadata(docs))

    def rows(batches):
        for batch in batches:
            x = text_view(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH, dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), lists, *(batch.column(c) for c in ("source", "lang", "n_chars"))], names=["doc_id", "th", "x", "source", "lang", "n_chars"])

    found = slim.mapInArrow(rows, "doc_id long, th long, x array<double>, source string, lang string, n_chars double")
    found = found.join(marks, "doc_id", "left").where("quality is null or used")
    return spread.stored(found.select("doc_id", "th", F.coalesce("quality", F.lit(-1)).alias("quality"), "x", "source", "lang", "n_chars"), "features")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    table = featured(docs, labels, sample)
    labelled = table.where("quality >= 0").orderBy("doc_id", "th", "source", "lang", "n_chars").toArrow()
    if not labelled.num_rows:
        return Model(1.0)
    batch = labelled.combine_chunks().to_batches()[0]
    views, y = _views(batch), np.asarray(batch.column("quality"))
    free, moved = table.where("quality < 0"), set()

    def surest(turn: int, learned: list[Logistic]):
        """The MOVED rows of each class that each view is most sure of, among all that are unlabelled still."""
        shared = docs.sparkSession.sparkContext.broadcast((learned, moved))

        def best(batches):
            models, gone = shared.value
            held: dict[tuple[int, int], pa.Table] = {}
            for batch in batches:
                views = _views(batch)
                keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True))
                new = np.array([k not in gone for k in keys], bool)
                for i, model in enumerate(models):
                    p = 1 / (1 + np.exp(-model.logit(views[i])))
                    for label, sure in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(new & (sure >= SURE))
                        at = at[np.argsort(-sure[at], kind="stable")[:MOVED]]
                        part = pa.Table.from_batches([batch.take(pa.array(at))]).append_column("sure", pa.array(sure[at]))
                        part = pa.concat_tables([held[i, label], part]) if (i, label) in held else part
                        held[i, label] = part.sort_by([("sure", "descending"), ("doc_id", "ascending"), ("th", "ascending")]).slice(0, MOVED)
            for (i, label), part in held.items():
                part = part.append_column("view", pa.array(np.full(len(part), i, np.int32))).append_column("label", pa.array(np.full(len(part), label, np.int32)))
                yield from part.select(["view", "label", "sure", "doc_id", "th", "x", "source", "lang", "n_chars"]).combine_chunks().to_batches()

        top = spread.stored(free.mapInArrow(best, "view int, label int, sure double, doc_id long, th long, x array<double>, source string, lang string, n_chars double"), "surest")
        each = [top.where((F.col("view") == i) & (F.col("label") == label)).orderBy(F.desc("sure"), "doc_id", "th").limit(MOVED) for i in (0, 1) for label in (1, 0)]
        got = reduce(DataFrame.union, each).toArrow()  # 4 * MOVED rows at most
        for i in (0, 1):
            for label in (1, 0):
                part = got.filter((pc.field("view") == i) & (pc.field("label") == label))
                if part.num_rows:
                    batch = part.combine_chunks().to_batches()[0]
                    moved.update(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True))
                    yield i, float(label), _views(batch)[1 - i]

    return co_train(views, y, surest)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with their score as one more column, of that name or, where they have it, the next free one."""
    (column,) = spread.free_names(docs, column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array(shared.value.score((text_view(texts), meta_view(source, lang, n_chars))))

    return docs.withColumn(column, score(F.coalesce("text", F.lit("")), *_metadata(docs)))


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    (name,) = spread.free_names(docs, "quality")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select("doc_id", "text", "source", "lang", "n_chars"), model).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
