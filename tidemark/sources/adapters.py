"""Canonical inputs out of the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    price = (F.get_json_object("props", "$.k").cast("int") + F.lit(0.5)) / F.lit(100.0)
    usd = F.col("value") * F.lit(10.0)
    side = F.when(kind.isin("click", "purchase"), "token1").when(kind.isin("view", "signup"), "token2").otherwise("other")
    return events.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("market_id"), side.alias("side"), price.alias("price"), usd.alias("usd_amount"), (usd / price).alias("token_amount"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("direction"), "event_id")


def raw_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cash = F.col("c_custkey"), F.abs(F.col("c_acctbal").cast("double"))
    yes = ((key % 100) + F.lit(0.5)) / F.lit(100.0)
    close = F.lit("2024-01-20").cast("timestamp_ntz") + F.make_dt_interval((key % 60).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("market_id"), F.col("c_name").alias("question"), yes.alias("yes_price"), (F.lit(1.0) - yes).alias("no_price"), (cash * F.lit(10.0)).alias("volume"), F.when(key % 17 == 0, F.lit(0.0)).otherwise(cash).alias("liquidity"), close.alias("close_time")
    )


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    maker = F.when(F.col("l_linestatus") == "F", "0").when(F.col("l_returnflag") == "R", F.concat(F.lit("N"), part)).otherwise(F.concat(F.lit("Y"), part))
    taker = F.when(F.col("l_linenumber") % 2 == 0, "1").when(F.col("l_linestatus") != "F", "0").otherwise(F.concat(F.lit("Y"), part))
    quantity = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string").alias("timestamp"), maker.alias("makerAssetId"), taker.alias("takerAssetId"), (quantity * F.lit(1e6)).cast("bigint").cast("string").alias("makerAmountFilled"),
        F.round(quantity * F.col("l_discount").cast("double") * F.lit(1e6)).cast("bigint").cast("string").alias("takerAmountFilled"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transactionHash"),
    )


def raw_fill_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(key.alias("id"), F.concat(F.lit("Y"), key).alias("token1"), F.concat(F.lit("N"), key).alias("token2"), F.col("p_partkey").alias("seq"))
