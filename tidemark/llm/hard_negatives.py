"""Hard-negative mining by threshold joins in the manner of L2AP (op13).

A vector's components become floor(256 * x); a row's score is its integer inner product with the anchor. An anchor's positives are its first
``POSITIVES`` other rows of its label; for each of them the window of a positive score p are the rows of other labels with 30 p <= 100 score <= 90 p,
of which the first ``NEGATIVES`` are returned. Higher scores come first, of equal ones the smaller vec_id.

All anchors meet all rows, block by block. In a block the rows' dimensions, most energetic first, are an inverted index that omits a row's last
dimensions as soon as the norm of the rest times an anchor's is below every threshold: these alone can't reach one. Partial scores are
accumulated along the index; what stays below its threshold even with the norms of the remaining dimensions is pruned, and what is
left is finished pair by pair. A block gives the first rows of each window at or above its threshold, and it is a window's full answer
if they are enough. Windows that don't fill are searched again with a lower threshold, down to their lower end. Thresholds come from a pilot: the
same search among one in ``PILOT`` rows, whose first, third and last place are tried one after the other.

Partial scores are exact: sums of integers below 2 ** 53 in doubles; rows whose norms could pass that are multiplied as Python's integers.
Defined cases: rows with a null label, a null vector or any null or non-finite component take no part; a null vec_id is no anchor and comes
after all others among equals; equal rows are rows of their own, each other's positives, and anchors each; missing components of a shorter vector are 0, an
empty vector scores 0 with all; components beyond 2 ** 62 count as that and scores beyond a long as its ends; negative positive scores have
no negatives, as their window is empty; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import spread, text

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A window is from LOW to HIGH hundredths of the positive score.
LOW, HIGH = 30, 90
#: Rows of a block, anchors that meet it at once, and anchors that are multiplied at once.
BLOCK, ANCHORS, STRIPE = 2048, 4096, 512
PILOT = 64
#: Dimensions that are accumulated between two prunings; pairs are finished one by one if so few are left.
STEP, SPARSE = 16, 0.02
EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def prepared(vectors: DataFrame, vec_id: str = "vec_id", label: Column | None = None, embedding: str = "embedding") -> DataFrame:
    """(rid, vec_id, label, vec) of the rows that take part, stored; vec: their integers, as floats that hold them."""
    wide = not isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    dtype = np.float64 if wide else np.float32
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>" if wide else "array<float>").alias("vec"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def whole(batches):
        for batch in batches:
            vec = batch.column("vec")
            counts = np.asarray(vec.value_lengths()).astype(np.int64)
            values = np.clip(np.floor(np.asarray(vec.flatten()).astype(np.float64) * SCALE), -(2.0**62), 2.0**62).astype(dtype)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text.blobs(values.view(np.uint8), np.append(0, np.cumsum(counts)) * values.itemsize)], names=["vec_id", "label", "vec"])

    rows = rows.mapInArrow(whole, "vec_id long, label long, vec binary")
    return spread.stored(rows.withColumns({"rid": F.monotonically_increasing_id(), "wide": F.lit(wide)}), "vectors")


def _matrix(column, wide: bool, dims: int) -> np.ndarray:
    """Rows of vectors, filled up with 0."""
    data, offsets = text.utf8(column)
    values = data.view(np.float64 if wide else np.float32).astype(np.float64)
    offsets = offsets // (8 if wide else 4)
    size = np.diff(offsets)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offsets[:-1], size)] = values
    return out


def _dims(table: pa.Table, wide: bool) -> int:
    return int(np.diff(text.utf8(table.column("vec"))[1]).max(initial=0)) // (8 if wide else 4)


def _rest(matrix: np.ndarray) -> np.ndarray:
    """Norms of what remains of each row from every dimension on, a little too large."""
    squares = np.zeros((len(matrix), matrix.shape[1] + 1))
    squares[:, :-1] = np.cumsum((matrix * matrix)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(squares) * (1 + 1e-9)


class Index:
    """An inverted index of a block's rows: each dimension's list has the rows whose remaining norm, from it on, reaches ``least``.

    Rows are sorted by their number of indexed dimensions, so that every list is a range of rows from the first on."""

    def __init__(self, rows: np.ndarray, least: float):
        self.order = np.argsort(-(rows * rows).sum(0), kind="stable")
        rows = rows[:, self.order]
        rest = _rest(rows)
        ends = np.minimum((rest >= least).sum(1), rows.shape[1])
        ends = np.minimum(-(-ends // STEP) * STEP, rows.shape[1])
        self.at = np.argsort(-ends, kind="stable")
        self.rows, self.rest, self.ends = rows[self.at], rest[self.at], ends[self.at]

    def reach(self, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of allowed pairs (anchors x the block's rows) whose score reaches the anchor's threshold."""
        anchors, allowed, dims = anchors[:, self.order], allowed[:, self.at], self.rows.shape[1]
        rest = _rest(anchors)
        live = np.arange(len(self.rows))
        sums, a, x, done = np.zeros((len(anchors), len(live))), None, None, None
        ends = self.ends
        for start in range(0, dims, STEP):
            stop = min(start + STEP, dims)
            n = int(np.searchsorted(-ends, -start))  # the first n live rows have this dimension in the index
            if n:
                sums[:, :n] += anchors[:, start:stop] @ self.rows[live[:n], start:stop].T
            now = np.minimum(ends, stop)
            able = allowed[:, live] & (sums + rest[:, now] * self.rest[live, now] >= least[:, None])
            some = able.any(0)
            if stop == dims or able.sum() <= SPARSE * able.size or not some.any():
                a, x = np.nonzero(able)
                partial, done, x = sums[a, x], now[x], live[x]
                break
            if some.mean() < 0.75:
                live, ends, sums = live[some], ends[some], np.ascontiguousarray(sums[:, some])
        if a is None:  # vectors without dimensions
            a, x = np.nonzero(allowed & (least <= 0)[:, None])
            return a, self.at[x], np.zeros(len(a))
        for start in range(int(done.min(initial=dims)), dims, STEP):
            stop = min(start + STEP, dims)
            due = np.flatnonzero(done <= start)
            partial[due] += np.einsum("ij,ij->i", anchors[a[due], start:stop], self.rows[x[due], start:stop])
            done[due] = stop
            keep = partial + rest[a, done] * self.rest[x, done] >= least[a]
            a, x, partial, done = a[keep], x[keep], partial[keep], done[keep]
        keep = partial >= least[a]
        return a[keep], self.at[x[keep]], partial[keep]


def _exactly(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by Python's integers, for norms whose product doubles can't hold."""
    a, x = np.nonzero(allowed)
    to_int = np.vectorize(int, otypes=[object])
    left, right = to_int(anchors), to_int(rows)
    score = np.array([min(max(int((left[i] * right[j]).sum()), _LEAST), _MOST) for i, j in zip(a.tolist(), x.tolist(), strict=True)], np.int64)
    keep = score >= least[a]
    return a[keep], x[keep], score[keep]


def _pair(k: int, same: bool):
    """Search of one block of anchors in one block of rows."""

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("anchor", pa.int64()), ("w", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        wide = rows.column("wide")[0].as_py()
        dims = max(_dims(anchors, wide), _dims(rows, wide))
        q, x = _matrix(anchors.column("vec"), wide, dims), _matrix(rows.column("vec"), wide, dims)
        q_rid, x_rid, q_label, x_label = (np.asarray(t.column(c)) for c in ("rid", "label") for t in (anchors, rows))
        ids = np.asarray(rows.column("vec_id").fill_null(_MOST))
        id_order = np.lexsort((ids, np.asarray(rows.column("vec_id").is_null()).astype(np.int8)))
        place = np.empty(len(ids), np.int64)
        place[id_order] = np.arange(len(ids))
        windows = anchors.column("windows").combine_chunks()
        owner = np.repeat(np.arange(len(q)), np.asarray(windows.value_lengths()).astype(np.int64))
        w, least, most = (np.asarray(windows.flatten().field(c)) for c in ("w", "least", "high"))
        low = np.full(len(q), _MOST)
        np.minimum.at(low, owner, least)
        q_norm, x_norm = _rest(q)[:, 0], _rest(x)[:, 0]
        huge = x_norm * q_norm.max() >= EXACT
        plain = np.flatnonzero(~huge)
        index = Index(x[plain], float((low / np.maximum(q_norm, 1e-9)).min()) if (low > 0).all() else -np.inf)
        out = [[] for _ in range(4)]
        for start in range(0, len(q), STRIPE):
            part = slice(start, start + STRIPE)
            allowed = ((q_label[part, None] == x_label[None, :]) == same) & (q_rid[part, None] != x_rid[None, :])
            a, b, score = index.reach(q[part], low[part].astype(np.float64), allowed[:, plain])
            b, score = plain[b], score.astype(np.int64)
            if huge.any():
                a2, b2, score2 = _exactly(q[part], x[huge], low[part], allowed[:, huge])
                a, b, score = np.append(a, a2), np.append(b, np.flatnonzero(huge)[b2]), np.append(score, score2)
            order = np.lexsort((place[b], -score.astype(np.float64) if huge.any() else -score, a))
            a, b, score = a[order] + start, b[order], score[order]
            if huge.any():  # doubles may tie what integers don't
                order = np.array(sorted(range(len(a)), key=lambda i: (a[i], -int(score[i]), place[b[i]])), np.int64)
                a, b, score = a[order], b[order], score[order]
            ends = np.searchsorted(a, np.arange(start, min(start + STRIPE, len(q)) + 1))
            for i in np.flatnonzero((owner >= start) & (owner < start + STRIPE)).tolist():
                here = slice(ends[owner[i] - start], ends[owner[i] - start + 1])
                hit = np.flatnonzero((score[here] >= least[i]) & (score[here] <= most[i]))[:k] + here.start
                for column, value in zip(out, (np.full(len(hit), q_rid[owner[i]]), np.full(len(hit), w[i]), b[hit], score[hit]), strict=True):
                    column.append(value)
        anchor, w, b, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table([pa.array(anchor, pa.int64()), pa.array(w, pa.int64()), rows.column("vec_id").take(pa.array(b.astype(np.int64))), pa.array(score, pa.int64())], schema=schema)

    return search


def _first(hits: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, windows: DataFrame, rows: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """(anchor, w, rank, vec_id, score), stored: the first k rows of each window (anchor, w, least, high) whose score is at least ``least``."""
    wanted = windows.groupBy("anchor").agg(F.collect_list(F.struct("w", "least", "high")).alias("windows"))
    wanted = spread.stored(anchors.join(wanted, anchors["rid"] == wanted["anchor"]).select("rid", "label", "vec", "wide", "windows"), "anchors")
    n_rows, n_anchors = max(1, -(-count // BLOCK)), max(1, -(-wanted.count() // ANCHORS))
    pieces = max(spread.partitions(rows), min(n_rows * n_anchors, 20_000))

    def dealt(df, own, others, pair):
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.withColumns({"own": F.pmod(F.xxhash64("rid"), F.lit(own)), "other": every}).withColumn("pair", pair).drop("own", "other").repartition(pieces, "pair").groupBy("pair")

    left = dealt(wanted, n_anchors, n_rows, F.col("own") * n_rows + F.col("other"))
    right = dealt(rows.select("rid", "vec_id", "label", "vec", "wide"), n_rows, n_anchors, F.col("other") * F.lit(n_rows).cast("long") + F.col("own"))
    hits = left.cogroup(right).applyInArrow(_pair(k, same), "anchor long, w long, vec_id long, score long")
    return spread.stored(_first(hits, k), "hits")


def fill(anchors: DataFrame, windows: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, w, rank, vec_id, score): the first k rows, or all, with a score from ``low`` to ``high`` of each window (anchor, w, low, high), w being
    unique for an anchor; same: whether rows of the anchor's label are sought, or those of others."""
    windows = spread.stored(windows, "windows")
    count = rows.count()
    pilot = rows.where(F.pmod(F.xxhash64("rid", F.lit("pilot")), F.lit(PILOT)) == 0)
    tried = _search(anchors, windows.withColumn("least", F.col("low")), pilot, -(-count // PILOT), k, same)
    place = {name: F.max(F.when(F.col("rank") == r, F.col("score"))).alias(name) for name, r in (("one", 1), ("three", min(3, k)), ("last", k))}
    steps = F.array_distinct(F.array_compact(F.array("one", "three", F.coalesce("last", "low"))))
    left = windows.join(tried.groupBy("anchor", "w").agg(*place.values()), ["anchor", "w"], "left").select("anchor", "w", "low", "high", steps.alias("steps"))
    left = spread.stored(left, "open")
    out, at = None, 0
    while not left.isEmpty():
        now = left.withColumn("least", F.try_element_at("steps", F.lit(at + 1)))
        found = _search(anchors, now, rows, count, k, same)
        full = found.where(F.col("rank") == k).select("anchor", "w")
        last = left.where(F.size("steps") <= at + 1).select("anchor", "w")
        ended = full.union(last).distinct()
        done = found.join(ended, ["anchor", "w"], "left_semi")
        out = done if out is None else out.union(done)
        left = spread.stored(left.join(ended, ["anchor", "w"], "left_anti"), "open")
        at += 1
    return out if out is not None else _nothing(rows)


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], "anchor long, w long, rank int, vec_id long, score long")


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``prepared`` rows and those of them that are anchors."""
    near = fill(anchors, anchors.select(F.col("rid").alias("anchor"), F.lit(0).cast("long").alias("w"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")), rows, positives, True)
    near = spread.stored(near.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    exact = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(exact * LOW / 100).cast("long"), F.floor(exact * HIGH / 100).cast("long")
    # positives of equal scores have the same window
    windows = near.where("positive_score >= 0").groupBy("anchor", "positive_score").agg(F.min("place").cast("long").alias("w")).select("anchor", "w", low.alias("low"), high.alias("high"), "positive_score")
    windows = spread.stored(windows.where("low <= high"), "windows")
    hard = fill(anchors, windows.select("anchor", "w", "low", "high"), rows, negatives, False)
    hard = hard.join(windows.select("anchor", "w", "positive_score"), ["anchor", "w"]).select("anchor", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return near.join(hard, ["anchor", "positive_score"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)
    return mined(rows, rows.where(F.col("vec_id") % 100 == 0))
