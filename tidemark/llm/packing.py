"""Packing into optimal length buckets (op5).

A document's length is its number of words (runs of non-space characters), one at least. The
global histogram of lengths goes through a dynamic program that finds the at most
``buckets`` boundaries with the least padding, exactly; every document is padded to its bucket's
boundary. Within a bucket, documents are numbered and cut into batches of at most ``budget`` padded tokens.

The histogram that the driver sees has a row for each length that occurs, so at most as many as the longest document has
words, and the program is linear in it. Numbering is by salted groups with offsets, so no bucket is ever one task.
Only DataFrame functions run on the executors. Defined cases: a null or empty text has length 0, counted as
one padded token; a document longer than the budget is a batch of its own; equal rows
take different slots; an empty table gives no rows; a null doc_id is numbered too; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import spread

BUCKETS, BUDGET, GROUP_ROWS = 8, 16384, 16384


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` ranges that cover all (length, count) with the least total padded length.

    best[k][j] = min over i of best[k-1][i] + length[j] * (count up to j - count up to i): for rising j the
    best lines lie on a convex hull that is walked once, so each layer takes linear time."""
    histogram = sorted(histogram)
    lengths, counts = [x for x, _ in histogram], [0]
    for _, c in histogram:
        counts.append(counts[-1] + c)
    n = len(lengths)
    if not n:
        return []
    best, choices = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall
        at, layer, choice = 0, [0] + [None] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, intercept = -counts[j - 1], best[j - 1]
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - slope) >= (intercept - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((slope, intercept, j - 1))
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            layer[j] = hull[at][0] * x + hull[at][1] + x * counts[j]
            choice[j] = hull[at][2]
        layer[0] = 0
        choices.append(choice)
        if best[n] is not None and layer[n] >= best[n]:
            choices.pop()
            break
        best = layer
    out, j = [], n
    for choice in reversed(choices):
        if j:
            out.append(lengths[j - 1])
            j = choice[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded, batch, slot of every document row."""
    own = spread.slim(docs).select("doc_id", "th", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens"))
    own = spread.stored(own.withColumns({"need": F.greatest("n_tokens", F.lit(1).cast("long")), "uid": F.monotonically_increasing_id()}), "lengths")
    histogram = [(x.need, x.n) for x in own.groupBy("need").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    bounds = boundaries(histogram, buckets)
    groups = max(1, -(-sum(n for _, n in histogram) // GROUP_ROWS))
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, bound in reversed(list(enumerate(bounds))):
        bucket, padded = F.when(F.col("need") <= bound, i).otherwise(bucket), F.when(F.col("need") <= bound, bound).otherwise(padded)
    placed = own.select("doc_id", "th", "n_tokens", bucket.alias("bucket"), padded.cast("long").alias("padded"), "uid", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("salt"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n")).select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own_number = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "th", "uid")) - 1
    numbered = placed.withColumn("number", own_number).join(offsets, ["bucket", "salt"]).withColumn("number", F.col("number") + F.col("start"))
    size = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1))
    return numbered.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("number") / size).cast("long").alias("batch"), F.pmod("number", size).cast("int").alias("slot"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
