"""Forward-looking win label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.gaps import by_market

ADDED = ("future_price", "future_return", "win")


def add_labels(df: DataFrame, forward: int = 6, min_move: float = 0.001) -> DataFrame:
    """future_price, future_return and win: 1 or 0 if the price moves by more than ``min_move`` for or against
    the bucket's dominant side, else null; return and win are null for excluded and empty buckets."""
    future = F.lead("mean_price", forward).over(by_market())
    df = df.withColumn("future_price", future)
    up, down = F.col("future_price") > F.col("mean_price") + F.lit(min_move), F.col("future_price") < F.col("mean_price") - F.lit(min_move)
    yes = F.col("yes_ratio") > 0.5
    win = F.when(yes, F.when(up, 1).when(down, 0)).otherwise(F.when(down, 1).when(up, 0))
    use = ~(F.coalesce("exclude_from_training", F.lit(False)) | F.coalesce("is_empty_bucket", F.lit(False)))
    return df.withColumns({"future_return": F.when(use, ratio(F.col("future_price") - F.col("mean_price"), "mean_price")), "win": F.when(use, win).cast("byte")})


def label_stats(df: DataFrame) -> DataFrame:
    labeled, wins = F.count("win"), F.count_if(F.col("win") == 1)
    return df.agg(
        F.count(F.lit(1)).alias("total"), labeled.alias("labeled"), (F.count(F.lit(1)) - labeled).alias("nullified"), wins.alias("wins"), F.count_if(F.col("win") == 0).alias("losses"),
        F.coalesce(F.try_divide(wins.cast("double"), labeled.cast("double")), F.lit(0.0)).alias("win_rate"), F.avg("future_return").alias("mean_return"), F.stddev_samp("future_return").alias("std_return"),
    )


def trainable(df: DataFrame) -> DataFrame:
    return df.where(F.col("win").isNotNull() & ~F.coalesce("exclude_from_training", F.lit(False)))
