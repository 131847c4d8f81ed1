"""Registered queries over the driver's tables; ``oracles`` has their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BacktestConfig, BucketConfig, ChunkConfig, FeatureConfig, ModelConfig, SourceConfig
from tidemark.functions.numeric import rounded
from tidemark.functions.shared import partitions, shared_path, stored
from tidemark.operators import backtest, chunks, features, gaps, labels, metrics, model, normalize, splits, strategies
from tidemark.plans import pipeline as plan
from tidemark.sources import adapters, convert, readers, runlog
from tidemark.streaming import live

CFG = BacktestConfig()
#: Rows of the grid whose features one task makes.
GRID_ROWS = 500_000
THRESHOLDS = [0.5, 0.55, 0.6, 0.7]
#: As many trees as the validation rows ask for, up to the reference's limit.
MODEL = ModelConfig(max_trees=5000)


def tidy(df: DataFrame, infinite: tuple[str, ...] = (), lift: float = 0.0) -> DataFrame:
    """Doubles rounded to six digits, counts as longs; where infinities can be, they are named in a column of their own.

    Means over windows lie on halves of the last digit, where the order of addition decides; ``lift``, a small share of each value,
    rounds these up everywhere."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        if c in infinite:
            out.append(F.when(F.abs(x) < float("inf"), F.round(x, 6)).alias(c))
            out.append(F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").alias(f"{c}_inf"))
        elif kind in ("double", "float"):
            out.append(F.round(x.cast("double") * F.lit(1.0 + lift) if lift else x.cast("double"), 6).alias(c))
        else:
            out.append(x.cast("long").alias(c) if kind in ("int", "tinyint", "smallint") else x)
    return df.select(*out)


def tidy_wide(df: DataFrame, infinite: tuple[str, ...], lift: float) -> DataFrame:
    """``tidy`` without negative zeros, for many columns of many rows. What ``filter`` does has no generated code, so Spark makes these columns apart from the
    stage's one method, which the JVM would not compile at this size, in methods of a few columns each, which it does."""
    below = float("inf")
    limits = {c: F.get(F.filter(F.array(F.col(c).cast("double")), lambda v: F.abs(v) < below), F.lit(0)) for c in infinite}
    return df.select(*(z for c, kind in df.dtypes for z in _tidied(c, kind, limits, lift)))


def _tidied(c: str, kind: str, limits: dict, lift: float) -> list:
    x = F.col(c)
    if c in limits:
        return [rounded(limits[c]).alias(c), F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").alias(f"{c}_inf")]
    if kind in ("double", "float"):
        return [rounded(x.cast("double") * F.lit(1.0 + lift)).alias(c)]
    return [x.cast("long").alias(c) if kind in ("int", "tinyint", "smallint") else x]


KEY = ("market_id", "bucket_time")


def normalize_trades(spark, sf):
    return tidy(plan.trades(spark, sf))


def normalize_markets(spark, sf):
    return tidy(plan.markets(spark, sf))


def _fills(spark, sf):
    return adapters.raw_fills(spark, sf), convert.token_lookup(adapters.raw_fill_markets(spark, sf), "seq")


def fills_etl(spark, sf):
    return tidy(convert.convert_fills(*_fills(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


def fills_counts(spark, sf):
    return convert.fill_counts(*_fills(spark, sf))


def token_lookup_join(spark, sf):
    raw, lookup = _fills(spark, sf)
    return raw.where("makerAssetId <> '0'").join(lookup, raw.makerAssetId == lookup.token).groupBy("side").agg(F.count(F.lit(1)).alias("fills"), F.count_distinct("market_id").alias("markets"))


def bucket_ohlcv(spark, sf):
    return tidy(plan.bucketed(spark, sf))


def bucket_whales(spark, sf):
    return tidy(plan.bucketed(spark, sf).where("whale_count > 0").select(*KEY, "trade_count", "whale_count", "whale_usd"))


def gap_summary(spark, sf):
    return tidy(gaps.detect_gaps(plan.bucketed(spark, sf), plan.MINUTES))


def gap_rollup(spark, sf):
    return tidy(gaps.gap_rollup(gaps.detect_gaps(plan.bucketed(spark, sf), plan.MINUTES)))


def gap_fill(spark, sf):
    return tidy(plan.filled(spark, sf))


def long_gap_edge(spark, sf):
    return gaps.flag_long_gaps(plan.filled(spark, sf)).select(*KEY, "is_empty_bucket", "in_long_gap")


def long_gap_run(spark, sf):
    return gaps.flag_long_gaps(plan.filled(spark, sf), mode="run_length").select(*KEY, "is_empty_bucket", "in_long_gap")


def exclusions(spark, sf):
    return gaps.exclusion_counts(plan.excluded(spark, sf))


def lag_features(spark, sf):
    df = features.lag_features(plan.filled(spark, sf))
    return tidy(df.select(*KEY, *(c for c in df.columns if "_lag" in c and not c.startswith("price_"))))


def price_returns(spark, sf):
    df = features.lag_features(plan.filled(spark, sf))
    return tidy(df.select(*KEY, *(c for c in df.columns if c.startswith(("price_change", "price_return")))))


def _rolling(*prefixes: str):
    def query(spark, sf):
        df = features.rolling_features(plan.filled(spark, sf))
        return tidy(df.select(*KEY, *(c for c in df.columns if c.startswith(prefixes))), lift=1e-12)

    return query


def market_features(spark, sf):
    df = features.market_features(plan.filled(spark, sf), plan.markets(spark, sf))
    return tidy(df.select(*KEY, *features.PRICES, "market_spread", "market_entropy", "days_to_close"))


INFINITE = ("trade_size_vs_liquidity", "volume_concentration", "momentum_per_day")


def cross_features(spark, sf):
    df = features.cross_features(features.market_features(plan.filled(spark, sf), plan.markets(spark, sf)))
    return tidy(df.select(*KEY, "entry_vs_market", "trade_size_vs_liquidity", "volume_concentration", "whale_ratio", "whale_momentum", "momentum_per_day"), INFINITE)


def time_features(spark, sf):
    df = features.time_features(plan.filled(spark, sf))
    return tidy(df.select(*KEY, "hour", "day_of_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend"))


def feature_matrix(spark, sf):
    """Each feature's known values and their mean, over all rows."""
    return _known(plan.featured(spark, sf))


def feature_chunks(spark, sf):
    """All features of all rows, from a table built by chunks of a week: first as of a time, then what came after."""
    grid, path = stored(plan.excluded(spark, sf), "grid"), shared_path(spark, "chunks")
    cfg, tasks = ChunkConfig(days=7, minutes=plan.MINUTES), max(partitions(grid), grid.count() // GRID_ROWS)
    chunks.build_chunks(grid.where(F.col("bucket_time") < datetime(2024, 1, 17)), plan.markets(spark, sf), path, cfg, tasks=tasks)
    chunks.build_chunks(grid, plan.markets(spark, sf), path, cfg, tasks=tasks)
    df = spark.read.parquet(path)
    return tidy_wide(df.select(*KEY, *(c for c in features.feature_columns(df) if c != "chunk_id")), INFINITE, lift=1e-12)


def low_memory_features(spark, sf):
    return _known(plan.featured(spark, sf, FeatureConfig.low_memory()))


def _known(df: DataFrame) -> DataFrame:
    """Each task counts and sums its columns; a row for each value, or two aggregates for each column in one, would cost many times that."""
    names = features.feature_columns(df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(len(names), np.int64), np.zeros(len(names))
        for batch in batches:
            for i, column in enumerate(batch.columns):
                x = column.to_numpy(zero_copy_only=False)  # null is NaN
                x = x[np.isfinite(x)]
                known[i] += len(x)
                total[i] += x.sum()
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(names))), "known": pa.array(known), "total": pa.array(total)})

    parts = df.select(*(F.col(c).cast("double").alias(c) for c in names)).mapInArrow(count, "at long, known long, total double")
    found = parts.groupBy("at").agg(F.sum("known").alias("known"), F.round(F.try_divide(F.sum("total"), F.sum("known").cast("double")), 5).alias("mean"))
    return found.select(F.get(F.array(*map(F.lit, names)), F.col("at").cast("int")).alias("feature"), "known", "mean")


def labels_(spark, sf):
    return tidy(plan.labeled(spark, sf).select(*KEY, "future_price", "future_return", "win"))


def label_stats(spark, sf):
    return tidy(labels.label_stats(plan.labeled(spark, sf)))


def _split_slim(spark, sf):
    return splits.walk_forward_split(plan.labeled(spark, sf))


def walk_forward_split(spark, sf):
    return _split_slim(spark, sf).select(*KEY, F.col("position").cast("long").alias("position"), "split")


def split_summary(spark, sf):
    return tidy(splits.split_summary(_split_slim(spark, sf)))


def holdout_split(spark, sf):
    return splits.time_holdout(labels.trainable(plan.labeled(spark, sf)), days=7, embargo_minutes=60).select(*KEY, "split")


def time_chunks(spark, sf):
    out = splits.time_chunks(plan.bucketed(spark, sf), days=7, context_buckets=60, minutes=plan.MINUTES)
    return out.groupBy("chunk_id", "is_context").agg(F.count(F.lit(1)).alias("rows"), F.min("bucket_time").alias("first_time"), F.max("bucket_time").alias("last_time"))


def _played(spark, sf):
    return plan.dataset(spark, sf, strategies.FEATURES).where("win is not null")


def aligned_features(spark, sf):
    """A model's features by name: one that is there, one that isn't."""
    df = normalize.align(plan.bucketed(spark, sf), ["mean_price", "absent", "trade_count"])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("mean_price"), 5).alias("mean_price"), F.count_if(F.isnan("absent")).alias("absent"), F.round(F.avg("trade_count"), 5).alias("trade_count"))


def time_range(spark, sf):
    return tidy(splits.time_range(plan.bucketed(spark, sf), datetime(2024, 1, 10), datetime(2024, 1, 20)).select(*KEY, "trade_count", "mean_price"))


def lookback(spark, sf):
    """Trades of the last 60 buckets before the latest trade, by market."""
    trades = plan.trades(spark, sf)
    now = trades.agg(F.max("timestamp")).first()[0]
    return tidy(readers.lookback(trades, now, 60, plan.MINUTES).groupBy("market_id").agg(F.count(F.lit(1)).alias("trades"), F.sum("usd_amount").alias("usd")))


def csv_round_trip(spark, sf):
    """Trades as CSV, half of the files with their columns in another order, read by each file's own header."""
    path = shared_path(spark, "csv")
    raw = adapters.raw_trades(spark, sf)
    for odd, names in ((0, raw.columns), (1, raw.columns[::-1])):
        half = raw.where(F.col("event_id") % 2 == odd).select(*names)
        half.write.mode("append").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return tidy(readers.load_trades(spark, SourceConfig(trades_path=path, format="csv")))


def stage_sink(spark, sf):
    """Buckets written by a codec, sorted and partitioned, copied once, and read back."""
    path = shared_path(spark, "stage")
    readers.write_table(plan.bucketed(spark, sf).withColumn("day", F.to_date("bucket_time")), path, "gzip", ("day",))
    return tidy(readers.cached(spark, spark.read.parquet(path), f"{path}-copy").drop("day"))


def convert_markets(spark, sf):
    """Raw markets with times in four spellings and some that are none, to canonical ones."""
    key = F.col("c_custkey")
    at = F.timestamp_seconds(F.lit(1705708800) + key % 60 * 86400)
    date, clock = F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH:mm:ss")
    spelled = F.when(key % 6 == 0, F.concat(date, F.lit("T"), clock, F.lit(".5Z"))).when(key % 6 == 1, F.concat(date, F.lit("T"), clock, F.lit("Z"))).when(key % 6 == 2, F.concat(date, F.lit(" "), clock, F.lit(" +00")))
    spelled = spelled.when(key % 6 == 3, F.concat(date, F.lit("T"), clock, F.lit("+01:00"))).when(key % 6 == 4, date).otherwise("soon")
    blank = {c: F.lit(None).cast("string").alias(c) for c in ("answer1", "answer2", "market_slug", "ticker", "token1", "token2")}
    raw = adapters.table(spark, sf, "customer").select(F.concat(F.lit(" "), key.cast("string")).alias("id"), F.concat("c_name", F.lit("  ")).alias("question"), *blank.values(), F.when(key % 7 == 0, "many").otherwise(F.round("c_acctbal", 2).cast("string")).alias("volume"), spelled.alias("closedTime"))
    out = convert.convert_markets(raw)
    return tidy(out.select("market_id", "question", "token1", "volume", F.unix_millis("close_time").alias("close_ms"), "yes_price"))


def _strategy(name: str):
    def query(spark, sf):
        return tidy(strategies.STRATEGIES[name](_played(spark, sf)).select(*KEY, "y", "p", "fires"))

    return query


def strategy_coverage(spark, sf):
    return tidy(strategies.coverage(strategies.long_form(_played(spark, sf))))


def _long(spark, sf):
    return strategies.long_form(_played(spark, sf))


def metrics_confusion(spark, sf):
    df = metrics.classification_metrics(_long(spark, sf), ["strategy"], CFG.threshold)
    return tidy(df.select("strategy", "n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1"))


def metrics_logloss_brier(spark, sf):
    return tidy(metrics.classification_metrics(_long(spark, sf), ["strategy"]).select("strategy", "log_loss", "brier"))


def metrics_auc(spark, sf):
    return tidy(metrics.roc_auc(_long(spark, sf), ["strategy"], 12))


def calibration(spark, sf):
    return tidy(metrics.calibration(_long(spark, sf), ["strategy"]))


ORDER = ["bucket_time", "market_id"]


def backtest_equity(spark, sf):
    return tidy(backtest.backtest(_long(spark, sf), ["strategy"], ORDER, CFG).drop("paid"))


def backtest_summary(spark, sf):
    return tidy(backtest.backtest_summary(backtest.backtest(_long(spark, sf), ["strategy"], ORDER, CFG), ["strategy"], CFG))


def threshold_sweep(spark, sf):
    return tidy(backtest.threshold_sweep(_long(spark, sf), THRESHOLDS, ["strategy"], ORDER, CFG))


def strategy_benchmark(spark, sf):
    df = strategies.strategy_benchmark(plan.split(spark, sf, wanted=strategies.FEATURES), digits=12)
    return tidy(df.select("strategy", "coverage", "status", "n", "auc", "brier", "trades", "total_pnl"))


def _momentum_score(df: DataFrame) -> DataFrame:
    return strategies.momentum(df.withColumn("win", F.lit(None).cast("byte"))).drop("y", "fires", "win")


def latest_signal(spark, sf):
    out = live.latest_signal(plan.bucketed(spark, sf), plan.markets(spark, sf), _momentum_score, 0.55, minutes=plan.MINUTES)
    return tidy(out.select("market_id", "bucket_time", "yes_ratio", "p", "signal"))


def _records(spark, sf):
    """Live records as producers spell them, three variants in turn; every fourth stands twice. Writing and parsing JSON is dealt to all cores, however few files there are."""
    events = adapters.raw_trades(spark, sf)
    e = events.repartition(partitions(events), "event_id").withColumn("s", F.unix_seconds(F.col("timestamp").cast("timestamp")))
    iso = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.to_json(F.struct(F.col("s").alias("timestamp"), "price", F.col("token_amount").alias("size"), F.lit("Yes").alias("outcome"), F.col("market_id").cast("string").alias("token_id"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"))))
    text = text.when(kind == 1, F.to_json(F.struct(iso.alias("created_at"), "price", F.col("token_amount").alias("amount"), F.lit("0").alias("outcome"), F.col("market_id").cast("string").alias("token_id"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("transactionHash"))))
    text = text.otherwise(F.to_json(F.struct(F.col("s").alias("time"), "price", F.lit("").alias("size"), F.when(F.col("event_id") % 5 > 0, F.col("token_amount")).alias("amount"), F.col("market_id").cast("string").alias("token_id"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("transaction_hash"))))
    return e.select(text.alias("value"), F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).select("value")


def json_trade_parse(spark, sf):
    return tidy(live.parse_trades(_records(spark, sf)))


def dedup_trades(spark, sf):
    return tidy(live.dedup_trades(live.parse_trades(_records(spark, sf))))


def _store(spark, sf) -> DataFrame:
    path = shared_path(spark, "store")
    live.dedup_trades(live.parse_trades(_records(spark, sf))).write.parquet(path)
    return spark.read.parquet(path)


def token_history(spark, sf):
    """One token's stored trades since a time."""
    return tidy(readers.history(_store(spark, sf), "7", 1704500000).select("token_id", "timestamp", "price", "is_yes", "tx_hash"))


def latest_trades(spark, sf):
    return live.latest_timestamps(_store(spark, sf))


def newer_trades(spark, sf):
    """Of all records, those after the latest of their token in a store that ends at a time."""
    trades = live.dedup_trades(live.parse_trades(_records(spark, sf)))
    return tidy(live.newer(trades, trades.where("timestamp < 1705300000")).select("token_id", "timestamp", "tx_hash"))


def unseen_trades(spark, sf):
    """Of all records, those that a store lacks: all after a time, and of before it the ones of a low price, which come late."""
    trades = live.dedup_trades(live.parse_trades(_records(spark, sf)))
    store = trades.where("timestamp < 1705300000 and price >= 0.1")
    return tidy(live.unseen(live.parse_trades(_records(spark, sf)), store).select("token_id", "timestamp", "price", "tx_hash"))


def retention(spark, sf):
    store = live.dedup_trades(live.parse_trades(_records(spark, sf)))
    now = store.agg(F.timestamp_seconds(F.max("timestamp"))).first()[0]
    return live.prune(store, 7, now).groupBy("token_id").agg(F.count(F.lit(1)).alias("trades"), F.max("timestamp").alias("latest"))


def live_buckets(spark, sf):
    """Hourly buckets of the records from one append query: parsed, deduplicated and aggregated on the stream; those that the watermark has closed."""
    path, sink, checkpoint = (shared_path(spark, name) for name in ("lines", "closed", "closed-checkpoint"))
    _records(spark, sf).write.text(path)
    live.bucket_stream(spark, path, sink, checkpoint, BucketConfig(minutes=plan.MINUTES), late="1 hour").awaitTermination()
    return tidy(spark.read.parquet(sink).select("token_id", "bucket_time", "trade_count", "total_usd", "total_tokens", "high_price", "low_price", "mean_price", "yes_ratio", "whale_count", "vwap"))


def run_history(spark, sf):
    """A run record for each day of events, appended as JSON, read back, the last five of each type."""
    day = F.to_date("timestamp")
    days = adapters.raw_trades(spark, sf).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg("price"), 6).alias("test_auc"))
    runs = days.select(F.when(F.dayofmonth("day") % 2 == 0, "model").otherwise("bench").alias("type"), F.col("day").cast("string").alias("ts"), "trades", "test_auc")
    path = shared_path(spark, "runlog")
    runlog.append_run(runs, path)
    return tidy(runlog.run_history(runlog.read_log(spark, path), 5).select("type", "ts", "trades", "test_auc"))


def strategy_roi(spark, sf):
    """A benchmark record for each day with the mean price of each side as its figure, pivoted."""
    rows = adapters.raw_trades(spark, sf).groupBy(F.to_date("timestamp").cast("string").alias("ts"), "side").agg(F.avg("price").alias("roi"))
    log = rows.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("side", "roi"))).alias("strategy_roi")).withColumn("type", F.lit("bench"))
    return tidy(runlog.strategy_roi_pivot(log, ["token1", "token2", "other"]))


def _model(spark, sf):
    df = plan.split(spark, sf)
    path = shared_path(spark, "dataset")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    names = [c for c in features.feature_columns(df) if c not in ("position", "question", "close_time")]
    return df, model.train(df, names, MODEL)


def model_train_score(spark, sf):
    df, fitted = _model(spark, sf)
    return tidy(model.evaluate(model.score(fitted, df)))


def feature_importance(spark, sf):
    df, fitted = _model(spark, sf)
    return tidy(model.importance(fitted, df, 20))


def stream_buckets(spark, sf):
    """The flagship's buckets, computed by a streaming query over the same file."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*").parquet(f"{sf}/events.parquet*")
    kind = F.col("event_type")
    price = (F.get_json_object("props", "$.k").cast("int") + F.lit(0.5)) / F.lit(100.0)
    usd = F.col("value") * F.lit(10.0)
    rows = source.select(F.col("user_id").alias("market_id"), F.col("ts").cast("timestamp").alias("event_time"), price.alias("price"), usd.alias("usd_amount"), (usd / price).alias("token_amount"), "event_id",
                         F.when(kind.isin("click", "purchase"), 1).when(kind.isin("view", "signup"), 0).otherwise(-1).alias("is_yes"), (F.col("event_id") % 2 == 0).cast("int").alias("is_buy")).withWatermark("event_time", "1 hour")
    out = live.stream_buckets(rows, BucketConfig(minutes=plan.MINUTES), "market_id", tiebreak="event_id")
    path, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    query = out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return tidy(spark.read.parquet(path))


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        normalize_trades, normalize_markets, fills_etl, fills_counts, token_lookup_join, bucket_ohlcv, bucket_whales, gap_summary, gap_rollup, gap_fill, long_gap_edge, long_gap_run, exclusions, lag_features, price_returns,
        market_features, cross_features, time_features, feature_matrix, feature_chunks, labels_, label_stats, low_memory_features, aligned_features, time_range, lookback, csv_round_trip, stage_sink, convert_markets, token_history, latest_trades, newer_trades, unseen_trades, walk_forward_split, split_summary, holdout_split, time_chunks, strategy_coverage, metrics_confusion, metrics_logloss_brier, metrics_auc,
        calibration, backtest_equity, backtest_summary, threshold_sweep, strategy_benchmark, latest_signal, json_trade_parse, dedup_trades, retention, live_buckets, run_history, strategy_roi, model_train_score, feature_importance, stream_buckets,
    )
}
QUERIES |= {"rolling_mean": _rolling("price_ma", "trade_count_ma", "momentum_ma"), "rolling_std": _rolling("price_std"), "rolling_sum": _rolling("volume_sum"), "price_vs_ma": _rolling("price_vs_ma")}
QUERIES |= {f"strategy_{name}": _strategy(name) for name in strategies.STRATEGIES}
