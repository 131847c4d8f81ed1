"""Live trades: parsing, ingest, retention, buckets on the stream, and scoring of the latest bucket."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.config import BucketConfig, FeatureConfig
from tidemark.functions.numeric import number, parsed_time
from tidemark.functions.shared import stored
from tidemark.operators.buckets import bucket_columns, finish
from tidemark.operators.features import build_features
from tidemark.operators.gaps import fill_buckets

RECORD = "timestamp string, created_at string, time string, price string, size string, amount string, outcome string, token_id string, transaction_hash string, transactionHash string, hash string"
#: The batch number of what a compaction has merged.
MERGED = -1
STORE = ("token_id", "timestamp", "price", "usd_amount", "token_amount", "is_yes", "tx_hash")


def _given(*names: str) -> Column:
    """The first field that is neither missing, empty nor zero."""
    return F.coalesce(*(F.when(~F.col(f"r.{n}").isin("", "0", "0.0"), F.col(f"r.{n}")) for n in names))


def _once(df: DataFrame, made: Column, name: str) -> DataFrame:
    """The column alone, computed once a row: conditions on what comes out of a generator stay behind it, while those on a
    projection go below it and compute it again for each mention."""
    return df.select(F.explode(F.array(made)).alias(name))


def parse_trades(lines: DataFrame, token: str | None = None, fractional: bool = False) -> DataFrame:
    """Trades of the store's shape from JSON records in column ``value``; incomplete ones are skipped.

    ``token`` is the one asked for; without it each record's own counts. Field names fall back as producers vary.
    Timestamps are whole seconds, or doubles with their fraction."""
    raw = _once(lines, F.from_json("value", RECORD), "r")
    when = _given("timestamp", "created_at", "time")
    second = F.coalesce(number(when), F.unix_micros(parsed_time(when)) / F.lit(1e6), F.unix_micros(when.try_cast("timestamp")) / F.lit(1e6))
    second = second if fractional else F.floor(second).cast("long")
    asked = F.lit(token) if token is not None else F.col("r.token_id")
    outcome = F.upper(F.coalesce("r.outcome", F.lit("")))
    is_yes = F.when(outcome.isin("YES", "1"), 1).when(outcome.isin("NO", "0"), 0).otherwise(F.when(F.coalesce("r.token_id", F.lit("")) == asked, 1).otherwise(0))
    fields = [asked.alias("token_id"), second.alias("timestamp"), number("r.price").alias("price"), number(_given("size", "amount")).alias("token_amount"), is_yes.alias("is_yes"), _given("transaction_hash", "transactionHash", "hash").alias("tx_hash")]
    out = _once(raw, F.struct(*fields), "t").select("t.*").where("timestamp is not null and price is not null and token_amount is not null")
    made = F.concat_ws("_", "token_id", F.col("timestamp").cast("string"), F.col("price").cast("string"))
    return out.withColumns({"usd_amount": F.col("price") * F.col("token_amount"), "tx_hash": F.coalesce("tx_hash", made)}).select(*STORE)


def dedup_trades(trades: DataFrame) -> DataFrame:
    """One row of each (token_id, tx_hash)."""
    return trades.dropDuplicates(["token_id", "tx_hash"])


def newer(trades: DataFrame, store: DataFrame) -> DataFrame:
    """Trades after the latest stored one of their token."""
    latest = latest_timestamps(store).withColumnRenamed("latest", "__latest")
    return trades.join(latest, "token_id", "left").where(F.col("timestamp") > F.coalesce("__latest", F.lit(0))).drop("__latest")


def unseen(trades: DataFrame, store: DataFrame) -> DataFrame:
    """Trades that the store doesn't have, by (token_id, tx_hash), whatever their time: late ones of a second that the store has passed count, which
    ``newer`` drops. Repeats within the batch become one; trades without a token or hash can't be known and stay.

    The store is first cut to the keys of the batch, so that only what is in both meets the second join: Spark broadcasts the keys if they are small enough, and then
    the store is read in two columns and not shuffled."""
    key = ["token_id", "tx_hash"]
    known = store.select(*key).join(trades.select(*key).distinct(), key, "left_semi")
    whole = F.col("token_id").isNotNull() & F.col("tx_hash").isNotNull()
    return dedup_trades(trades.where(whole)).join(known, key, "left_anti").unionByName(trades.where(~whole)).select(*trades.columns)


def latest_timestamps(store: DataFrame) -> DataFrame:
    return store.groupBy("token_id").agg(F.max("timestamp").alias("latest"))


def prune(store: DataFrame, keep_days: int, now: datetime) -> DataFrame:
    """What a compaction keeps: trades of the last days."""
    return store.where(F.timestamp_seconds("timestamp") >= F.lit(now - timedelta(days=keep_days)))


def trade_stream(spark: SparkSession, path: str, token: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Deduplicated trades from landed JSON lines, with event_time and a watermark."""
    return watched(parse_trades(spark.readStream.text(path), token), late)


def watched(trades: DataFrame, late: str) -> DataFrame:
    """A stream's trades with event_time, a watermark and no repeats within it."""
    timed = trades.withColumn("event_time", F.timestamp_seconds("timestamp"))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["token_id", "tx_hash"])


def ingest_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, token: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """Appends new trades to a store that is partitioned by date and micro-batch, so that a batch that is replayed replaces what
    it wrote before. Without a trigger interval it stops when all is read."""
    rows = trade_stream(spark, path, token).withColumn("date", F.to_date("event_time"))

    def append(df: DataFrame, number_: int) -> None:
        df.withColumn("batch", F.lit(number_)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(sink)

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def compact(spark: SparkSession, store: str, keep_days: int, now: datetime, most_files: int = 1) -> dict[str, int]:
    """Retention and merging of small files in a store that ``ingest_stream`` wrote; how many dates were dropped and rewritten.

    Dates before the last ``keep_days`` are dropped whole; the date on the edge, and dates of more than ``most_files`` files, are rewritten, clustered by
    token and time, with one row of each trade; all others are left as they are. No batch may be written meanwhile. If it is interrupted,
    trades of a date may stand twice until the next compaction; ``dedup_trades`` reads over that."""
    edge = (now - timedelta(days=keep_days)).date()
    files: dict[str, int] = {}
    for name in spark.read.parquet(store).inputFiles():
        date = re.search(r"/date=([^/]+)/", name).group(1)
        files[date] = files.get(date, 0) + 1
    old = sorted(d for d in files if d < edge.isoformat())
    changed = sorted(d for d, n in files.items() if d not in old and (n > most_files or d == edge.isoformat()))
    if changed:
        rows = prune(spark.read.parquet(store).where(F.col("date").cast("string").isin(changed)), keep_days, now)
        rows = stored(dedup_trades(rows).withColumn("batch", F.lit(MERGED)), "compacted")
        by = ("date", "token_id", "timestamp", "tx_hash")
        clustered = rows.repartitionByRange(*by).sortWithinPartitions("date", "batch", *by[1:])
        clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(store)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for date in [*old, *changed]:
        folder = jvm.org.apache.hadoop.fs.Path(f"{store}/date={date}")
        system = folder.getFileSystem(conf)
        for part in [folder] if date in old else [x.getPath() for x in system.listStatus(folder) if x.getPath().getName() != f"batch={MERGED}"]:
            system.delete(part, True)
    return {"dropped": len(old), "rewritten": len(changed)}


def bucket_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, cfg: BucketConfig = BucketConfig(), token: str | None = None, late: str = "10 minutes", files_per_batch: int | None = None) -> StreamingQuery:
    """Buckets from landed JSON lines in one append query: parsed, deduplicated within the watermark, aggregated by window. A bucket is written
    once, when the watermark (the latest trade less ``late``) has passed its end, and its state goes; trades that come after that are dropped."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    out = stream_buckets(watched(parse_trades(reader.text(path), token), late), cfg, tiebreak="tx_hash")
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_buckets(stream: DataFrame, cfg: BucketConfig = BucketConfig(), key: str = "token_id", time: str = "event_time", tiebreak: str | None = None) -> DataFrame:
    """The batch path's buckets over a stream, whose time column is a timestamp with a watermark."""
    rows = stream.withColumn("timestamp", F.col(time))
    keyed = rows.groupBy(key, F.window(time, f"{cfg.minutes} minutes").alias("w"))
    out = finish(keyed.agg(*bucket_columns(rows, cfg.whale_usd, tiebreak)))
    return out.withColumn("bucket_time", F.col("w.start").cast("timestamp_ntz")).drop("w")


def decide(df: DataFrame, threshold: float) -> DataFrame:
    """BID YES, BID NO or NO BID: the dominant side, if its chance of a win reaches the threshold."""
    yes = F.coalesce("yes_ratio", F.lit(0.5)) > 0.5
    return df.withColumn("signal", F.when(F.col("p") >= threshold, F.when(yes, "BID YES").otherwise("BID NO")).otherwise("NO BID"))


def latest_rows(df: DataFrame, key: str = "market_id") -> DataFrame:
    """The last bucket of each market, by one aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), "bucket_time").alias("r")).select(key, "r.*")


def latest_signal(buckets: DataFrame, markets: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, cfg: FeatureConfig = FeatureConfig(), minutes: int = 5, last: int = 60, fill: bool = True) -> DataFrame:
    """The decision for each market's latest bucket, from its last buckets' features."""
    at = F.max("bucket_time").over(Window.partitionBy("market_id"))
    recent = buckets.withColumn("__last", at).where(F.timestamp_diff("MINUTE", F.col("bucket_time"), F.col("__last")) < last * minutes).drop("__last")
    filled = fill_buckets(recent, minutes) if fill else recent
    return decide(score(latest_rows(build_features(filled, markets, cfg))), threshold)


def rings(stream: DataFrame, last: int = 60, minutes: int = 5, ttl: timedelta = timedelta(days=1)) -> DataFrame:
    """Per micro-batch the last buckets of each market that it touched, from state: a ring of the buckets within ``last`` of the newest.

    A bucket that comes again replaces the one of its time. A market is forgotten when the watermark, ``ttl`` behind the latest bucket of all, has passed
    its own latest one by as much; buckets that are older than the watermark are dropped."""
    schema = to_arrow_schema(StructType([f for f in stream.schema if f.name != "market_id"]))
    span, keep = timedelta(minutes=last * minutes), int(ttl.total_seconds() * 1000)

    def turn(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [pa.Table.from_pandas(f[schema.names], schema, preserve_index=False) for f in frames]
        if state.exists:
            parts.insert(0, pa.ipc.open_stream(bytes(state.get[0])).read_all())
        table = pa.concat_tables(parts)
        time = np.asarray(table.column("bucket_time").cast("timestamp[us]"))
        order = np.argsort(time, kind="stable")
        newest = np.append(time[order][1:] != time[order][:-1], True)  # of equal times the one that came last
        kept = order[newest & (time[order] > time.max() - np.timedelta64(span))]
        table = table.take(pa.array(kept))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(int(time.max().astype("datetime64[ms]").astype(np.int64)) + keep)
        out = table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int8(): pd.Int8Dtype(), pa.int32(): pd.Int32Dtype()}.get)
        out.insert(0, "market_id", key[0])
        yield out

    out = StructType([stream.schema["market_id"], *(f for f in stream.schema if f.name != "market_id")])
    known = stream.where("market_id is not null and bucket_time is not null").withColumn("__at", F.col("bucket_time").cast("timestamp"))
    known = known.withWatermark("__at", f"{int(ttl.total_seconds())} seconds")
    return known.groupBy("market_id").applyInPandasWithState(turn, out, "ring binary", "update", GroupStateTimeout.EventTimeTimeout)


def score_stream(stream: DataFrame, sink: str, checkpoint: str, markets: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, minutes: int = 5, last: int = 60, ttl: timedelta = timedelta(days=1)) -> StreamingQuery:
    """Per micro-batch of buckets (market_id, bucket_time, ...) the signals of the markets it touched, from their last buckets, which are kept as state.

    Signals go to a folder of the batch in ``sink`` (column ``batch``), which a replay of the batch writes anew: after a failure
    the stream goes on where it stopped, and each batch gives its signals once."""

    def batch(df: DataFrame, number_: int) -> None:
        latest_signal(df, markets, score, threshold, minutes=minutes, last=last).write.mode("overwrite").parquet(f"{sink}/batch={number_}")

    ring = rings(stream, last, minutes, ttl)
    return ring.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
