"""Features of each bucket: lags, rolling windows, market, cross and time columns.

All windows share one partitioning and order, so the plan has one shuffle and one sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.numeric import clip, ratio
from tidemark.operators.gaps import by_market
from tidemark.operators.normalize import PRICES

LAGGED = ("mean_price", "total_usd", "trade_count", "momentum", "yes_ratio")
ROLLED = {"__price": "mean_price", "__usd": "total_usd", "__trades": "trade_count", "__momentum": "momentum"}
METADATA = ("market_id", "bucket_time", "is_empty_bucket", "in_gap", "in_long_gap", "exclude_from_training", "future_price", "future_return", "win", "close_time", "split")


def lag_features(df: DataFrame, lags: tuple[int, ...] = FeatureConfig.lags) -> DataFrame:
    return _changes(_lagged(df, lags), lags)


def _lagged(df: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(by_market()) for c in LAGGED for k in lags})


def _changes(df: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    out = {}
    for k in lags:
        before = F.col(f"mean_price_lag{k}")
        out[f"price_change_lag{k}"] = F.col("mean_price") - before
        out[f"price_return_lag{k}"] = ratio(F.col("mean_price") - before, before)
    return df.withColumns(out)


def _summed(df: DataFrame, columns: dict[str, str], windows: tuple[int, ...], squares: str | None) -> DataFrame:
    """Sums over the last n rows as <name>_sum<n>, null unless all n have a value, and squared deviations of one column.

    Windows are put together from those of 1, 2, 4, ... rows: each step adds what a lag gives, so a row costs the logarithm of a
    window, not its length, and nothing cancels out as in differences of running sums. Squared deviations of two halves
    add up with the square of the difference of their means."""
    w, top = by_market(), max(windows)
    parts = {1: {f"{k}_s1": F.col(c).cast("double") for k, c in columns.items()}}
    if squares:
        parts[1][f"{squares}_q1"] = F.when(F.col(columns[squares]).isNotNull(), F.lit(0.0))
    df = df.withColumns(parts[1])
    names = list(parts[1])

    def joined(n: int, m: int, name: str) -> dict:
        """Of the last n rows and the m before them, with column names ending in ``name``."""
        out = {f"{k}_s{name}": F.col(f"{k}_s{n}") + F.lag(f"{k}_s{m}", n).over(w) for k in columns}
        if squares:
            apart = F.col(f"{squares}_s{n}") / F.lit(float(n)) - F.lag(f"{squares}_s{m}", n).over(w) / F.lit(float(m))
            out[f"{squares}_q{name}"] = F.col(f"{squares}_q{n}") + F.lag(f"{squares}_q{m}", n).over(w) + apart * apart * F.lit(n * m / (n + m))
        return out

    made, width = {1}, 1
    while 2 * width <= top:
        more = joined(width, width, str(2 * width))
        df, names, width = df.withColumns(more), names + list(more), 2 * width
        made.add(width)
    waiting = {n: (1 << n.bit_length() - 1, n - (1 << n.bit_length() - 1)) for n in windows if n not in made}
    while waiting:  # one round for each further bit of a window's length
        more = {}
        for n, (done, left) in list(waiting.items()):
            bit = 1 << left.bit_length() - 1
            more |= joined(done, bit, str(done + bit))
            waiting[n] = (done + bit, left - bit)
            if left == bit:
                del waiting[n]
        df, names = df.withColumns(more), list(dict.fromkeys(names + list(more)))
    kept = [f"{k}_s{n}" for n in windows for k in columns] + ([f"{squares}_q{n}" for n in windows] if squares else [])
    return df.drop(*(c for c in names if c not in kept))


def _summed_in_order(df: DataFrame, columns: dict[str, str], windows: tuple[int, ...], squares: str) -> DataFrame:
    """The columns of ``_summed``, each window's rows added up one by one from the first, as SQL's plain frame does: the last bits
    are those of that order, and a row costs the length of its windows."""
    out = {}
    for n in windows:
        frame = by_market().rowsBetween(1 - n, 0)
        for k, c in columns.items():
            x, whole = F.col(c).cast("double"), F.count(c).over(frame) == n
            out[f"{k}_s{n}"] = F.when(whole, F.sum(x).over(frame))
            if k == squares:
                out[f"{k}_q{n}"] = F.when(whole, F.var_pop(x).over(frame) * F.lit(float(n)))
    return df.withColumns(out)


def rolling_features(df: DataFrame, windows: tuple[int, ...] = FeatureConfig.windows, in_order: bool = False) -> DataFrame:
    """Means, sums and deviations over the last n buckets, null unless each of them has a value."""
    return _rolled((_summed_in_order if in_order else _summed)(df, ROLLED, windows, "__price"), windows)


def _rolled(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    out = {}
    for n in windows:
        size = F.lit(float(n))
        out |= {f"price_ma{n}": F.col(f"__price_s{n}") / size, f"price_std{n}": F.sqrt(F.col(f"__price_q{n}") / (size - F.lit(1.0))) if n > 1 else F.lit(None).cast("double"), f"volume_sum{n}": F.col(f"__usd_s{n}")}
        out |= {f"trade_count_ma{n}": F.col(f"__trades_s{n}") / size, f"momentum_ma{n}": F.col(f"__momentum_s{n}") / size}
    df = df.withColumns(out).drop(*(f"{k}_s{n}" for k in ROLLED for n in windows), *(f"__price_q{n}" for n in windows))
    return df.withColumns({f"price_vs_ma{n}": ratio(F.col("mean_price") - F.col(f"price_ma{n}"), f"price_ma{n}") for n in windows})


def market_features(df: DataFrame, markets: DataFrame) -> DataFrame:
    """Market columns by market_id. Spark broadcasts the dimension if its size in bytes allows, and joins by shuffle otherwise."""
    side = markets.select("market_id", *(c for c in (*PRICES, "close_time") if c in markets.columns))
    df = df.join(side, "market_id", "left")
    p = clip(F.col("yes_price").cast("double"), 1e-9, 1 - 1e-9)
    out = {"market_spread": F.abs(F.col("yes_price").cast("double") - F.col("no_price").cast("double")), "market_entropy": -(p * F.log2(p) + (F.lit(1.0) - p) * F.log2(F.lit(1.0) - p))}
    if "close_time" in side.columns:
        out["days_to_close"] = F.timestamp_diff("SECOND", F.col("bucket_time"), F.col("close_time").cast("timestamp_ntz")) / F.lit(86400.0)
    return df.withColumns(out)


def cross_features(df: DataFrame) -> DataFrame:
    out = {
        "entry_vs_market": F.col("mean_price") - F.col("yes_price").cast("double"),
        "trade_size_vs_liquidity": ratio("total_usd", "liquidity"),
        "volume_concentration": ratio("total_usd", "volume"),
        "whale_ratio": F.when(F.col("trade_count") == 0, F.when(F.col("whale_count") == 0, F.lit(0.0)).otherwise(ratio("whale_count", "trade_count"))).otherwise(ratio("whale_count", "trade_count")),
        "momentum_per_day": ratio("momentum", F.col("days_to_close") + F.lit(1.0)),
    }
    return df.withColumns(out).withColumn("whale_momentum", F.col("whale_ratio") * F.col("momentum"))


def time_features(df: DataFrame) -> DataFrame:
    """The weekday counts from Monday as 1, and from 5 on is taken as weekend, so a Friday is."""
    hour, day = F.hour("bucket_time"), F.weekday("bucket_time") + 1
    turn = F.lit(2 * math.pi)
    return df.withColumns(
        {"hour": hour, "day_of_week": day, "hour_sin": F.sin(turn * hour / F.lit(24.0)), "hour_cos": F.cos(turn * hour / F.lit(24.0)), "dow_sin": F.sin(turn * day / F.lit(7.0)), "dow_cos": F.cos(turn * day / F.lit(7.0)), "is_weekend": (day >= 5).cast("int")}
    )


def build_features(filled: DataFrame, markets: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    # all windows first: their steps pass rows on while these are still narrow, and a filter on the result gets down to them, so
    # that what is made from their values is made for its rows only
    df = _lagged((_summed_in_order if cfg.in_order else _summed)(filled, ROLLED, cfg.windows, "__price"), cfg.lags)
    lagged = [f"{c}_lag{k}" for c in LAGGED for k in cfg.lags]
    df = market_features(_changes(_rolled(df, cfg.windows), cfg.lags), markets)
    df = time_features(cross_features(df) if cfg.cross_features else df)
    rest = [c for c in df.columns if c not in lagged]
    after = rest.index(f"price_vs_ma{cfg.windows[-1]}") + 1
    return df.select(*rest[:after], *lagged, *rest[after:])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in METADATA]
