"""Fixed-width OHLCV buckets of each market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio


def bucket_columns(df: DataFrame, whale_usd: float, tiebreak: str | None) -> list:
    """The statistics of a group of trades: shared by the batch and the streaming path."""
    order = F.struct("timestamp", tiebreak) if tiebreak else F.col("timestamp")
    whale = F.col("usd_amount") > whale_usd
    out = [
        F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(F.sum("usd_amount"), F.lit(0.0)).alias("total_usd"),
        F.coalesce(F.sum("token_amount"), F.lit(0.0)).alias("total_tokens"),
        F.min_by("price", order).alias("open_price"),
        F.max_by("price", order).alias("close_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.avg("price").alias("mean_price"),
        F.avg("is_yes").alias("yes_ratio"),
        F.count_if(whale).alias("whale_count"),
        F.coalesce(F.sum(F.when(whale, F.col("usd_amount"))), F.lit(0.0)).alias("whale_usd"),
        F.sum(F.col("price") * F.col("usd_amount")).alias("weighted"),
    ]
    return out + ([F.avg("is_buy").alias("buy_ratio")] if "is_buy" in df.columns else [])


def finish(df: DataFrame) -> DataFrame:
    """vwap and momentum from what was summed."""
    return df.withColumns({"vwap": ratio("weighted", "total_usd"), "momentum": F.col("close_price") - F.col("open_price")}).drop("weighted")


def aggregate_trades(trades: DataFrame, minutes: int = 5, whale_usd: float = 1000.0, tiebreak: str | None = None) -> DataFrame:
    """One row for each market and bucket with a trade; buckets are aligned to the epoch."""
    keyed = trades.groupBy("market_id", F.window("timestamp", f"{minutes} minutes").alias("w"))
    return finish(keyed.agg(*bucket_columns(trades, whale_usd, tiebreak)).withColumn("bucket_time", F.col("w.start")).drop("w"))
