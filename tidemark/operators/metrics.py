"""Exact classification metrics of (y, p) rows, grouped by any keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def classification_metrics(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 where undefined), log loss and Brier score."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
        F.avg(-F.ln(F.greatest(F.least(F.when(pos, F.col("p")).otherwise(F.lit(1.0) - F.col("p")), F.lit(1 - EPS)), F.lit(EPS)))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
    )

    def share(n, d):
        return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": share(tp + tn, F.col("n")), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """Area under the ROC curve with half credit for ties, from counts per distinct score; null with one class.
    With ``digits``, scores that agree in so many digits are tied, so that how sums were added up doesn't decide.

    Scores are ranked within narrow ranges and ranges by their totals, so no task sorts all scores of a key."""
    rows = df if digits is None else df.withColumn("p", F.round("p", digits))
    scores = rows.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(F.lit(1.0) - F.col("y")).alias("neg"))
    scores = scores.withColumn("__range", F.floor(F.col("p") * F.lit(4096.0)))
    below = F.sum("neg").over(Window.partitionBy(*keys, "__range").orderBy("p")) - F.col("neg")
    ranked = scores.withColumn("__credit", F.col("pos") * (below + F.lit(0.5) * F.col("neg")))
    ranges = ranked.groupBy(*keys, "__range").agg(F.sum("__credit").alias("__credit"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    under = F.sum("neg").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("neg")
    return ranges.withColumn("__under", F.col("pos") * under).groupBy(*keys).agg(F.try_divide(F.sum("__credit") + F.sum("__under"), F.sum("pos") * F.sum("neg")).alias("auc"))


def calibration(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Half-open bins of p; empty ones are left out, and p = 1 is in none."""
    edge = [i * (1.0 / bins) for i in range(bins + 1)]
    edge[-1] = 1.0
    index = F.lit(None).cast("int")
    for i in range(bins):
        index = F.when((F.col("p") >= edge[i]) & (F.col("p") < edge[i + 1]), i).otherwise(index)
    binned = df.withColumn("bin", index).where("bin is not null")
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y")).withColumn("center", (F.col("bin") + F.lit(0.5)) / F.lit(float(bins)))
