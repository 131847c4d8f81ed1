"""Calendar completion: gap summaries, filling, long runs of empty buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.config import Gap

CARRIED = ("open_price", "close_price", "high_price", "low_price", "mean_price", "vwap", "momentum")


def by_market() -> WindowSpec:
    """The one window of all row-offset work: a market in time order."""
    return Window.partitionBy("market_id").orderBy("bucket_time")


def detect_gaps(bucketed: DataFrame, minutes: int = 5, gap: Gap = Gap()) -> DataFrame:
    """How much of each market's calendar is there."""
    found = bucketed.groupBy("market_id").agg(F.min("bucket_time").alias("first_bucket"), F.max("bucket_time").alias("last_bucket"), F.count(F.lit(1)).alias("actual_buckets"))
    span = F.timestamp_diff("SECOND", F.col("first_bucket"), F.col("last_bucket"))
    return (
        found.withColumn("expected_buckets", (F.floor(span / F.lit(minutes * 60)) + 1).cast("long"))
        .withColumn("missing_buckets", F.col("expected_buckets") - F.col("actual_buckets"))
        .withColumn("missing_ratio", F.col("missing_buckets") / F.col("expected_buckets").cast("double"))
        .withColumn("overlaps_gap", (F.col("first_bucket") < F.lit(gap.end).cast("timestamp_ntz")) & (F.col("last_bucket") > F.lit(gap.start).cast("timestamp_ntz")))
    )


def gap_rollup(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("markets"), F.avg("missing_ratio").alias("mean_missing_ratio"), F.count_if(F.col("missing_ratio") > 0.5).alias("sparse_markets"))


def fill_buckets(bucketed: DataFrame, minutes: int = 5, gap: Gap = Gap()) -> DataFrame:
    """Every bucket between a market's first and last: counts and sums 0, prices carried forward, ratios even.

    The grid starts at a market's first row. Of several rows of one time all stay, in any order; rows off the grid
    go, but the grid reaches as far as the last of them."""
    before = by_market().rowsBetween(Window.unboundedPreceding, 0)
    step, time = F.expr(f"interval {minutes} minutes"), F.col("bucket_time")
    known = bucketed.where("market_id is not null and bucket_time is not null")
    passed = F.timestamp_diff("MICROSECOND", F.first("bucket_time").over(before), time)
    known = known.withColumn("__off", F.pmod(passed, F.lit(minutes * 60_000_000)))
    known = known.withColumns({"__slot": time - F.make_dt_interval(secs=F.col("__off") / F.lit(1e6)), "__on": F.col("__off") == 0})
    # prices are carried over the buckets there are; then each is repeated up to the next one, so there is one scan and one shuffle
    carried = {c: F.last(F.when(F.col("__on"), F.col(c)), ignorenulls=True).over(before) for c in CARRIED}
    known = known.withColumns(carried | {"__next": F.lead("__slot").over(by_market()), "__same": F.coalesce(F.lag("__slot").over(by_market()) == F.col("__slot"), F.lit(False))})
    slot, following = F.col("__slot"), F.col("__next")
    own = F.when(F.col("__on") | ~F.col("__same"), F.array(F.struct(slot.alias("time"), (~F.col("__on")).alias("empty")))).otherwise(F.array())
    ahead = F.when(following > slot + step, F.transform(F.sequence(slot + step, following - step, step), lambda x: F.struct(x.alias("time"), F.lit(True).alias("empty")))).otherwise(F.array())
    full = known.withColumn("__at", F.explode(F.concat(own, ahead)))
    empty = F.col("__at.empty")
    columns = {c: F.col(c) for c in bucketed.columns}
    columns |= {c: F.when(empty, F.lit(0).cast("long")).otherwise(F.coalesce(c, F.lit(0).cast("long"))) for c in ("trade_count", "whale_count")}
    columns |= {c: F.when(empty, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("total_usd", "total_tokens", "whale_usd")}
    columns |= {c: F.when(empty, F.lit(0.5)).otherwise(F.coalesce(c, F.lit(0.5))) for c in ("yes_ratio", "buy_ratio") if c in bucketed.columns}
    columns |= {"bucket_time": F.col("__at.time"), "is_empty_bucket": empty | F.col("trade_count").isNull()}
    columns["in_gap"] = (F.col("__at.time") >= F.lit(gap.start).cast("timestamp_ntz")) & (F.col("__at.time") < F.lit(gap.end).cast("timestamp_ntz"))
    return full.select(*(v.alias(k) for k, v in columns.items()))


def flag_long_gaps(filled: DataFrame, max_empty: int = 48, mode: str = "edge") -> DataFrame:
    """in_long_gap for buckets of long empty runs.

    ``edge``: more than ``max_empty`` empty buckets up to here, or from here on, so that the middle of a run
    of up to twice that length is not flagged; ``run_length``: the whole run is longer."""
    island = F.sum(F.when(~F.col("is_empty_bucket"), 1).otherwise(0)).over(by_market().rowsBetween(Window.unboundedPreceding, 0))
    out = filled.withColumn("__island", island)
    if mode == "run_length":
        n = F.count(F.lit(1)).over(Window.partitionBy("market_id", "__island", "is_empty_bucket"))
        return out.withColumn("__n", n).withColumn("in_long_gap", F.col("is_empty_bucket") & (F.col("__n") > max_empty)).drop("__island", "__n")
    # a row of the same island that far away and, if before, itself empty: everything between is empty. No other sort of the rows is needed
    place = F.struct("__island", "is_empty_bucket")
    out = out.withColumns({"__back": F.lag(place, max_empty).over(by_market()), "__ahead": F.lead("__island", max_empty).over(by_market())})
    back = (F.col("__back.__island") == F.col("__island")) & F.col("__back.is_empty_bucket")
    long = F.coalesce(back, F.lit(False)) | F.coalesce(F.col("__ahead") == F.col("__island"), F.lit(False))
    return out.withColumn("in_long_gap", F.col("is_empty_bucket") & long).drop("__island", "__back", "__ahead")


def apply_gap_exclusions(df: DataFrame) -> DataFrame:
    return df.withColumn("exclude_from_training", F.coalesce("in_gap", F.lit(False)) | F.coalesce("in_long_gap", F.lit(False)))


def exclusion_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_empty_bucket").alias("empty_rows"), F.count_if("exclude_from_training").alias("excluded_rows"), F.count_distinct("market_id").alias("markets"))
