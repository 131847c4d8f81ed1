"""Canonical trades and markets from whatever the source calls its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SourceConfig

PRICES = ("yes_price", "no_price", "volume", "liquidity")


def normalize_trades(df: DataFrame, cfg: SourceConfig = SourceConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """timestamp, market_id, is_yes, price, usd_amount, token_amount and, with a direction, is_buy.

    A side that is neither is -1, as is a missing one. ``keep`` names further columns, such as a tie-break."""
    df = df.withColumnsRenamed({v: k for k, v in cfg.columns.items() if v in df.columns and v != k})
    side = F.when(F.col("side") == cfg.yes_side, 1).when(F.col("side") == cfg.no_side, 0).otherwise(-1)
    out = [F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("market_id").cast("long").alias("market_id"), side.cast("byte").alias("is_yes")]
    out += [F.col(c).cast("double").alias(c) for c in ("price", "usd_amount", "token_amount")]
    if "direction" in df.columns:
        out.append(F.col("direction").contains("BUY").cast("byte").alias("is_buy"))
    return df.select(*out, *keep)


def normalize_markets(df: DataFrame) -> DataFrame:
    """market_id, close_time and the four price columns (null where the source has none) beside the rest."""
    names = {"id": "market_id", "closedTime": "close_time"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})
    df = df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast("float") for c in PRICES})
    return df.withColumn("market_id", F.col("market_id").cast("long"))


def align(df: DataFrame, features: list[str]) -> DataFrame:
    """The features by name, NaN where one is missing; others are left out."""
    return df.select(*((F.col(c).cast("double") if c in df.columns else F.lit(float("nan"))).alias(c) for c in features))
