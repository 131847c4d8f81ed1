"""Features by chunk of time: a stored table that grows by the chunks that are new."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ChunkConfig, FeatureConfig
from tidemark.functions.shared import small_methods
from tidemark.operators.features import build_features


def chunk_of(cfg: ChunkConfig = ChunkConfig()):
    """Number of a row's chunk, counted from ``cfg.origin``, so that it doesn't move with the data."""
    second = F.timestamp_diff("SECOND", F.lit(cfg.origin).cast("timestamp_ntz"), F.col("bucket_time"))
    return F.floor(second / F.lit(cfg.days * 86400)).cast("long")


def known_chunks(df: DataFrame, path: str) -> list[int]:
    """Numbers of the chunks in a stored table; they are partitions, so no rows are read."""
    try:
        return sorted(x.chunk_id for x in df.sparkSession.read.parquet(path).select("chunk_id").distinct().collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return []


def runs(chunks: list[int]) -> list[tuple[int, int]]:
    """First and last of each unbroken run."""
    out: list[tuple[int, int]] = []
    for c in sorted(set(chunks)):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def chunk_features(filled: DataFrame, markets: DataFrame, chunks: list[int], cfg: ChunkConfig = ChunkConfig(), wanted: FeatureConfig = FeatureConfig(), tasks: int | None = None) -> DataFrame:
    """The features of some chunks' rows, equal to those over the whole grid. Of what is before a run of chunks only the last ``cfg.context`` buckets
    are read; both ends are conditions on the time, which reach the scan of a stored grid. Markets are dealt to ``tasks``, or by Spark's setting."""
    reach = max([*wanted.lags, *(n - 1 for n in wanted.windows)], default=0)
    if cfg.context < reach:
        raise ValueError(f"features look back {reach} buckets, the context has {cfg.context}")
    time, parts = F.col("bucket_time"), []
    for first, last in runs(chunks):
        start, stop = (cfg.origin + timedelta(days=cfg.days * n) for n in (first, last + 1))
        rows = filled.where((time >= F.lit(start - timedelta(minutes=cfg.context * cfg.minutes))) & (time < F.lit(stop)))
        rows = rows.repartition(tasks, "market_id") if tasks else rows
        parts.append(build_features(rows, markets, wanted).where(time >= F.lit(start)).withColumn("chunk_id", chunk_of(cfg)))
    return reduce(DataFrame.unionByName, parts)


def build_chunks(filled: DataFrame, markets: DataFrame, path: str, cfg: ChunkConfig = ChunkConfig(), wanted: FeatureConfig = FeatureConfig(), chunks: list[int] | None = None, tasks: int | None = None) -> list[int]:
    """Writes the features of ``chunks``, each in place of what was there of it, and leaves all others alone; returns their numbers.

    Without ``chunks``, those that the table doesn't have, and its last one, which may have been open when it was built. A chunk that got late rows is named
    by the caller, and with it the next one, as it sees these rows as context."""
    if chunks is None:
        there = known_chunks(filled, path)
        found = [x[0] for x in filled.where("bucket_time is not null").select(chunk_of(cfg)).distinct().collect()]  # one row a chunk
        chunks = [c for c in found if c not in there[:-1]]
    if chunks:
        # written by the tasks that made them: another shuffle would move all columns of all rows once more
        rows = chunk_features(filled, markets, chunks, cfg, wanted, tasks).sortWithinPartitions("chunk_id", "market_id", "bucket_time")
        with small_methods(filled.sparkSession):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)
    return sorted(chunks)
