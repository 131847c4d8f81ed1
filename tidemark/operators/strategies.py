"""Seven rule-based strategies: each adds y (its target), p (its score) and fires."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import BacktestConfig, FeatureConfig
from tidemark.functions.numeric import clip, finite, finite_or, sigmoid
from tidemark.functions.shared import stored


def _yes() -> Column:
    return F.col("yes_ratio") > 0.5


def _first(df: DataFrame, *names: str) -> Column:
    found = [c for c in names if c in df.columns]
    if not found:
        raise ValueError(f"none of {names} is there")
    return F.col(found[0])


def _played(df: DataFrame, score: Column, fires: Column, against: bool = False) -> DataFrame:
    """Rows where a strategy doesn't fire score an even 0.5; one that bets against has the other target."""
    win = F.col("win").cast("double")
    return df.withColumns({"y": F.lit(1.0) - win if against else win, "p": F.when(fires, score).otherwise(F.lit(0.5)), "fires": F.coalesce(fires, F.lit(False))})


def baseline(df: DataFrame) -> DataFrame:
    return _played(df, F.lit(0.95), F.lit(True))


def random(df: DataFrame, seed: int = 42) -> DataFrame:
    """Uniform by a hash of market, time and seed: the same however rows are partitioned."""
    text = F.concat_ws("|", F.col("market_id").cast("string"), F.col("bucket_time").cast("string"), F.lit(str(seed)))
    return _played(df, F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0), F.lit(True))


def momentum(df: DataFrame) -> DataFrame:
    change = _first(df, "price_change_lag3", "price_change_lag2", "price_change_lag1")
    d = finite_or(F.when(_yes(), change).otherwise(-change))
    return _played(df, sigmoid(d * F.lit(20.0)), F.abs(d) > 0.005)


def reversion(df: DataFrame, threshold: float = 0.04) -> DataFrame:
    d = finite_or(_first(df, "price_vs_ma24", "price_vs_ma12"))
    fires = (_yes() & (d > threshold)) | (~_yes() & (d < -threshold))
    return _played(df, F.lit(0.5) + F.lit(0.5) * clip(F.abs(d) / F.lit(0.2), 0.0, 1.0), fires, against=True)


def volume(df: DataFrame, spike: float = 3.0) -> DataFrame:
    mean = _first(df, "volume_sum24") / F.lit(24.0)
    r = finite_or(F.when(mean > 0, F.col("total_usd") / mean), 1.0)
    return _played(df, F.lit(0.5) + F.lit(0.5) * clip((r - F.lit(1.0)) / F.lit(spike * 3 - 1), 0.0, 1.0), r >= spike)


def closing(df: DataFrame, max_days: float = 14.0, min_directional: float = 0.15) -> DataFrame:
    """The direction is twice the distance from 0.5, and that is what is tested."""
    days = finite_or(_first(df, "days_to_close"), 999.0)
    urgency = clip(F.lit(1.0) - days / F.lit(max_days), 0.0, 1.0)
    off = F.col("mean_price") - F.lit(0.5)
    direction = clip(F.when(_yes(), off).otherwise(-off), 0.0, 0.5) / F.lit(0.5)
    fires = (days >= 0) & (days < max_days) & (direction > min_directional) & (urgency > 0.05)
    return _played(df, clip(F.lit(0.5) + urgency * direction * F.lit(0.45), 0.0, 1.0), fires)


def contrarian(df: DataFrame, side: float = 0.65, price: float = 0.65) -> DataFrame:
    r, m = F.col("yes_ratio"), F.col("mean_price")
    fires = ((r > side) & (m > price)) | ((r < 1 - side) & (m < 1 - price))
    strength = F.least(F.abs(r - F.lit(0.5)) * F.lit(2.0), F.abs(m - F.lit(0.5)) * F.lit(2.0))
    return _played(df, F.lit(0.5) + F.lit(0.5) * strength, fires, against=True)


#: What the strategies look at first, of all lags and windows. Their conditions and bins decide on a sum's last bit, so sums are in order.
FEATURES = FeatureConfig(lags=(3,), windows=(24,), cross_features=False, in_order=True)
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"baseline": baseline, "random": random, "momentum": momentum, "reversion": reversion, "volume": volume, "closing": closing, "contrarian": contrarian}


def long_form(df: DataFrame, names: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """(strategy, market_id, bucket_time, y, p, fires) of all strategies, from one pass over the rows."""
    kept, scored = [], df
    for name in names:
        try:
            scored = STRATEGIES[name](scored)
        except ValueError:
            continue  # a strategy whose features aren't there is left out, the others stand
        scored = scored.withColumn(f"__{name}", F.struct(F.lit(name).alias("strategy"), "y", "p", "fires")).drop("y", "p", "fires")
        kept.append(f"__{name}")
    return scored.select("market_id", "bucket_time", F.explode(F.array(*kept)).alias("s")).select("s.strategy", "market_id", "bucket_time", "s.y", "s.p", "s.fires")


def test_period(df: DataFrame) -> DataFrame:
    """Rows from the first time of the positional test slice on, ties included."""
    start = df.where("split = 'test'").agg(F.min("bucket_time").alias("__start"))
    return df.crossJoin(F.broadcast(start)).where("bucket_time >= __start").drop("__start")  # one row


def coverage(long: DataFrame) -> DataFrame:
    return long.groupBy("strategy").agg(F.avg(F.col("fires").cast("double")).alias("coverage"))


def strategy_benchmark(df: DataFrame, cfg: BacktestConfig = BacktestConfig(), digits: int | None = None) -> DataFrame:
    """One row per strategy: coverage, status, metrics and backtest; ``digits`` as in ``metrics.roc_auc``."""
    from tidemark.operators import backtest, metrics

    long = stored(long_form(test_period(df)), "played")  # all parts read these few columns instead of making the features anew
    valid = long.where(finite("p") & finite("y")).withColumn("p", clip("p", 1e-7, 1 - 1e-7))
    state = valid.groupBy("strategy").agg(F.when(F.count(F.lit(1)) < 10, "too few rows").when(F.min("y") == F.max("y"), "one class").otherwise("ok").alias("status"))
    parts = [
        state,
        metrics.classification_metrics(valid, ["strategy"], cfg.threshold),
        metrics.roc_auc(valid, ["strategy"], digits),
        backtest.backtest_summary(backtest.backtest(valid, ["strategy"], ["bucket_time", "market_id"], cfg), ["strategy"], cfg),
    ]
    return reduce(lambda a, b: a.join(b, "strategy", "left"), parts, coverage(long))
