"""Time-ordered splits that leave a purge and a gap between train, validation and test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SplitConfig
from tidemark.functions.shared import stored
from tidemark.operators.labels import trainable


def positions(df: DataFrame) -> DataFrame:
    """``position`` in (bucket_time, market_id) order: rows before the time, then a number within it.

    The running count is over the times of a day and over days, so no window has all rows or all times in one partition."""
    return _placed(df, _times(df))


def _times(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket_time").agg(F.count(F.lit(1)).alias("__n"))


def _placed(df: DataFrame, times: DataFrame) -> DataFrame:
    times = times.withColumn("__day", F.to_date("bucket_time"))
    earlier = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = times.groupBy("__day").agg(F.sum("__n").alias("__total")).select("__day", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__base"))
    before = Window.partitionBy("__day").orderBy("bucket_time").rowsBetween(Window.unboundedPreceding, -1)
    times = times.join(days, "__day").select("bucket_time", (F.col("__base") + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("bucket_time").orderBy("market_id"))
    return df.withColumn("__in", inside).join(times, "bucket_time").withColumn("position", F.col("__before") + F.col("__in") - 1).drop("__in", "__before")


def split_bounds(n: int, cfg: SplitConfig = SplitConfig()) -> tuple[int, int, int, int]:
    """End of train, start and end of validation, start of test; gap and purge are halved once if n is too small."""
    train, validation = int(n * cfg.train), int(n * cfg.validation)
    gap, purge = cfg.gap, cfg.purge
    for _ in range(2):
        start = train + gap
        stop = start + validation - purge
        if stop + gap < n:
            return max(1, train - purge), start, max(start + 1, stop), stop + gap
        gap, purge = max(1, gap // 2), max(1, purge // 2)
    raise ValueError(f"{n} rows are too few for this split")


def walk_forward_split(df: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Trainable rows with ``split``: train, validation, test, or null in gaps and purged ranges."""
    rows = trainable(df)
    times = stored(_times(rows), "times")  # one row a time, from one slim pass over the rows
    train, start, stop, test = split_bounds(times.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0], cfg)
    at = F.col("position")
    return _placed(rows, times).withColumn("split", F.when(at < train, "train").when((at >= start) & (at < stop), "validation").when(at >= test, "test"))


def split_summary(df: DataFrame) -> DataFrame:
    return df.where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("bucket_time").alias("first_time"), F.max("bucket_time").alias("last_time"), F.avg(F.col("win").cast("double")).alias("win_rate"))


def time_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("bucket_time").alias("t_min"), F.max("bucket_time").alias("t_max"))


def time_range(df: DataFrame, start, stop) -> DataFrame:
    """Rows with start <= bucket_time <= stop; the filter reaches the scan."""
    return df.where(F.col("bucket_time").between(F.lit(start), F.lit(stop)))


def time_holdout(df: DataFrame, days: int = 60, embargo_minutes: int = 60) -> DataFrame:
    """``split``: the last ``days`` are test, rows up to the embargo before them train, those between null."""
    cut = F.col("t_max") - F.make_dt_interval(F.lit(days))
    out = df.crossJoin(F.broadcast(time_bounds(df).select("t_max")))  # one row
    time = F.col("bucket_time")
    return out.withColumn("split", F.when(time >= cut, "test").when(time < cut - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(embargo_minutes)), "train")).drop("t_max")


def time_chunks(df: DataFrame, days: int = 90, context_buckets: int = 60, minutes: int = 5) -> DataFrame:
    """Each row in its chunk of ``days``, and once more as context of the next one if it is just before it. ``operators.chunks`` builds features by chunk."""
    out = df.crossJoin(F.broadcast(time_bounds(df).select("t_min")))  # one row
    width, context = days * 86400, context_buckets * minutes * 60
    second = F.timestamp_diff("SECOND", F.col("t_min"), F.col("bucket_time"))
    chunk = F.floor(second / F.lit(width)).cast("long")
    late = (F.lit(width) * (chunk + 1) - second) <= context
    own = F.struct(chunk.alias("chunk_id"), F.lit(False).alias("is_context"))
    ahead = F.struct((chunk + 1).alias("chunk_id"), F.lit(True).alias("is_context"))
    copies = F.explode(F.when(late, F.array(own, ahead)).otherwise(F.array(own)))
    return out.withColumn("__c", copies).select(*df.columns, "__c.chunk_id", "__c.is_context")
