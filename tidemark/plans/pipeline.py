"""The batch chain as one lazy plan, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import FeatureConfig, SplitConfig
from tidemark.functions.shared import partitions, stored
from tidemark.operators import buckets, features, gaps, labels, normalize, splits
from tidemark.sources import adapters, readers

MINUTES = 60
#: Events whose grid one task has.
EVENTS = 50_000


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_trades(adapters.raw_trades(spark, sf), keep=("event_id",))


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_markets(adapters.raw_markets(spark, sf))


def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.aggregate_trades(trades(spark, sf), MINUTES, tiebreak="event_id")


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """Markets are dealt to as many tasks as the input needs: the grid has many times the buckets' rows, and each task sorts its part."""
    buckets_ = bucketed(spark, sf)
    tasks = max(partitions(buckets_), adapters.table(spark, sf, "events").count() // EVENTS)  # from the files' footers
    return gaps.fill_buckets(buckets_.repartition(tasks, "market_id"), MINUTES)


def excluded(spark: SparkSession, sf: str, mode: str = "edge") -> DataFrame:
    return gaps.apply_gap_exclusions(gaps.flag_long_gaps(filled(spark, sf), mode=mode))


def featured(spark: SparkSession, sf: str, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    return features.build_features(excluded(spark, sf), markets(spark, sf), cfg)


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return labels.add_labels(excluded(spark, sf))


def dataset(spark: SparkSession, sf: str, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Features with labels: what is trained and played on. Labels come first, so that rows without one can go before all but the windows is made."""
    df = features.build_features(labels.add_labels(excluded(spark, sf)), markets(spark, sf), cfg)
    return df.select(*(c for c in df.columns if c not in labels.ADDED), *labels.ADDED)


def stages(spark: SparkSession, sf: str, keep: str | None = None) -> dict[str, DataFrame]:
    """The chain's stages by name. With ``keep``, a folder, each is written there and the next one starts from what was written."""
    out: dict[str, DataFrame] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        if keep:
            readers.write_table(df, f"{keep}/{name}")
            df = spark.read.parquet(f"{keep}/{name}")
        out[name] = df
        return df

    grid = stage("filled", gaps.fill_buckets(stage("bucketed", bucketed(spark, sf)), MINUTES))
    used = gaps.apply_gap_exclusions(gaps.flag_long_gaps(grid))
    stage("labeled", labels.add_labels(stage("features", features.build_features(used, markets(spark, sf)))))
    return out


def split(spark: SparkSession, sf: str, cfg: SplitConfig = SplitConfig(), wanted: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The trainable rows with their features are stored, a small part of the grid, which is then made once."""
    return splits.walk_forward_split(stored(labels.trainable(dataset(spark, sf, wanted)), "trainable"), cfg)
