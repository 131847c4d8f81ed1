"""Run history as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "type string, ts string, model string, threshold double, fwd_buckets long, trades long, test_auc double, test_roi double, test_sharpe double, test_trades long, strategy_roi map<string,double>"


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records; malformed lines are skipped, a missing log is empty."""
    try:
        return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def run_history(log: DataFrame, n: int = 10) -> DataFrame:
    """The last n runs of each type; of one time those whose record as text comes first."""
    last = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("ts"), F.to_json(F.struct(*log.columns))))
    return log.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def strategy_roi_pivot(log: DataFrame, strategies: list[str]) -> DataFrame:
    """One row per benchmark run, one column per strategy."""
    rows = log.where("type = 'bench'").select("ts", F.explode("strategy_roi").alias("strategy", "roi"))
    return rows.groupBy("ts").pivot("strategy", strategies).agg(F.first("roi"))
