"""Reading and writing tables: CSV with stated schemas, Parquet, JDBC, and cached copies."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.config import SourceConfig
from tidemark.operators.normalize import normalize_markets, normalize_trades

TRADES_CSV = "timestamp timestamp_ntz, market_id long, side string, price double, usd_amount double, token_amount double, direction string, tx_hash string"
MARKETS_CSV = "market_id long, question string, answer1 string, answer2 string, volume float, close_time timestamp, market_slug string, ticker string, token1 string, token2 string, yes_price float, no_price float, liquidity float"


def read_table(spark: SparkSession, path: str, cfg: SourceConfig, schema: str | None = None) -> DataFrame:
    if cfg.format == "parquet":
        return spark.read.parquet(path)
    if cfg.format == "csv":
        return read_csv(spark, path, schema)
    if cfg.format == "jdbc":
        reader = spark.read.format("jdbc").option("url", cfg.jdbc_url).option("dbtable", path)
        if cfg.jdbc_partition_column:
            low, high = cfg.jdbc_bounds
            reader = reader.option("partitionColumn", cfg.jdbc_partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", cfg.jdbc_partitions)
        return reader.load()
    raise ValueError(f"no such format: {cfg.format}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with headers, whose columns may differ from file to file in number and order.

    One line a file is read ahead, by a small job of its own; files of one header are one typed scan. A column that a file doesn't have is null,
    of columns of one name the first counts, what can't be read is null, and files without any line are left out."""
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    with ThreadPoolExecutor(16) as pool:
        first = list(pool.map(lambda f: spark.read.text(f).head(1), files))
    groups: dict[str, list[str]] = {}
    for file, line in zip(files, first, strict=True):
        if line and line[0].value.strip():
            groups.setdefault(line[0].value, []).append(file)
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schema).fields} if schema else {}
    scans = []
    for line, some in sorted(groups.items()):
        names = [x.strip() for x in next(csv.reader([line.removeprefix("\ufeff")]))]
        raw = spark.read.schema(StructType([StructField(f"_{i}", StringType()) for i in range(len(names))])).option("header", True).csv(some)
        place = {name: F.col(f"_{i}") for i, name in reversed(list(enumerate(names)))}
        scans.append(raw.select(*(place[c].try_cast(kinds[c]).alias(c) if c in kinds else place[c].alias(c) for c in dict.fromkeys(names))))
    if not scans:
        return spark.createDataFrame([], StructType([StructField(c, k) for c, k in kinds.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def load_trades(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    return normalize_trades(read_table(spark, cfg.trades_path, cfg, TRADES_CSV), cfg)


def load_markets(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    return normalize_markets(read_table(spark, cfg.markets_path, cfg, MARKETS_CSV))


def write_table(df: DataFrame, path: str, codec: str = "snappy", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ("market_id", "bucket_time"), files: int | None = None, replace: bool = False) -> None:
    """Parquet, clustered by the partition columns and then ``sort_by``: each task has a range of them, in order, so that a partition has few
    files and statistics prune. The number of files follows Spark's target size of partitions, or is ``files``. With ``replace``, only partitions that have rows are written anew."""
    keys = [*partition_by, *(c for c in sort_by if c in df.columns and c not in partition_by)]
    if keys:
        df = df.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys)
    mode = "dynamic" if replace else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", codec).partitionBy(*partition_by).parquet(path)


def cached(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """A copy at ``path``, written once and used from then on; one that was never finished, or has other columns, is written anew."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        copy = spark.read.parquet(path)
        if dict(copy.dtypes) == dict(df.dtypes):
            return copy
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def history(store: DataFrame, token: str, since: int) -> DataFrame:
    """A token's stored trades since a Unix time, in order; both conditions reach the scan."""
    return store.where((F.col("token_id") == token) & (F.col("timestamp") >= since)).orderBy("timestamp", "tx_hash")


def lookback(df: DataFrame, now: datetime, buckets: int = 60, minutes: int = 5, column: str = "timestamp") -> DataFrame:
    return df.where(F.col(column) >= F.lit(now - timedelta(minutes=buckets * minutes)))
