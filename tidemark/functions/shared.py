"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, only a session in one process gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(folder or '/tmp/checkpoints/tidemark').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: computed once, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For actions on very wide rows: the JVM never compiles a method of over 8000 bytes of code, and Spark by default puts a whole stage in one.
    Inside, Spark splits such a stage's expressions into methods that are compiled. Results are the same."""
    key, limit = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), limit))
    try:
        yield
    finally:
        spark.conf.set(key, before)
