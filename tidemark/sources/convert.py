"""Raw exchange exports to canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import number, parsed_time, unix_time

_TEXT = ("question", "answer1", "answer2", "market_slug", "ticker", "token1", "token2")


def convert_markets(raw: DataFrame) -> DataFrame:
    """Canonical markets from strings: missing text is empty, what can't be read as a number or time is null."""
    text = [F.coalesce(F.trim(c), F.lit("")).alias(c) for c in _TEXT]
    return raw.select(number("id", "int").alias("market_id"), *text, number("volume", "float").alias("volume"), parsed_time("closedTime").alias("close_time"), *(F.lit(None).cast("float").alias(c) for c in ("yes_price", "no_price", "liquidity")))


def token_lookup(raw_markets: DataFrame, order: str | None = None) -> DataFrame:
    """(token, market_id, side): of several markets with a token the last one in ``order`` counts."""
    seq = F.col(order) if order else F.monotonically_increasing_id()
    rows = raw_markets.select(number("id", "long").alias("market_id"), seq.alias("seq"), F.trim("token1").alias("token1"), F.trim("token2").alias("token2")).where("market_id is not null")
    pairs = F.explode(F.array(F.struct(F.col("token1").alias("token"), F.lit("token1").alias("side")), F.struct(F.col("token2").alias("token"), F.lit("token2").alias("side"))))
    rows = rows.withColumn("t", pairs).select("t.token", "t.side", "market_id", "seq").where("token != ''")
    return rows.groupBy("token").agg(F.max_by(F.struct("market_id", "side"), F.struct("seq", "side")).alias("m")).select("token", "m.market_id", "m.side")


def _classified(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every fill with its market, amounts and kind: settlement, unmatched or kept."""
    raw = raw.withColumns({c: F.coalesce(F.trim(c), F.lit("")) for c in ("makerAssetId", "takerAssetId")})
    units = {k: number(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "0").otherwise(F.trim(c)), "bigint") for k, c in (("token_units", "makerAmountFilled"), ("usd_units", "takerAmountFilled"))}
    found = raw.withColumns(units).join(lookup, F.col("makerAssetId") == F.col("token"), "left")
    kind = F.when(F.col("makerAssetId") == "0", "settlement").when(F.col("market_id").isNull() | F.col("token_units").isNull() | F.col("usd_units").isNull(), "unmatched").otherwise("kept")
    return found.withColumn("kind", kind)


def convert_fills(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Canonical trades: settlement legs and fills of unknown tokens are dropped.

    Spark broadcasts the lookup if its size in bytes allows, and joins by shuffle otherwise."""
    rows = _classified(raw.where(F.coalesce(F.trim("makerAssetId"), F.lit("")) != "0"), lookup).where("kind = 'kept'")
    usd, tokens = F.col("usd_units") / F.lit(1e6), F.col("token_units") / F.lit(1e6)
    return rows.select(
        unix_time("timestamp").alias("timestamp"), "market_id", "side", F.when(tokens > 0, usd / tokens).alias("price"), usd.alias("usd_amount"), tokens.alias("token_amount"),
        F.when(F.col("takerAssetId") == "0", "BUY").otherwise("SELL").alias("direction"), F.coalesce("transactionHash", F.lit("")).alias("tx_hash"),
    )


def fill_counts(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    rows = _classified(raw, lookup)
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("kept", "settlement", "unmatched")))
