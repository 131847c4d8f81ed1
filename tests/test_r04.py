import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.config import ChunkConfig, FeatureConfig
from tidemark.functions.numeric import rounded
from tidemark.operators import chunks
from tidemark.plans import pipeline, queries

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_rounding_is_that_of_decimals(spark):
    """Also at and beside half of the last digit, where products decide wrongly, and for what is no plain number."""
    near = [k / 2e6 + e for k in range(-4001, 4001, 7) for e in (0.0, 1e-17, -1e-17, 1e-12, -1e-12)]
    far = [s * (10.0**p + k * 5e-7) for p in range(12) for k in range(20) for s in (1, -1)]
    odd = [0.0, -0.0, -1e-9, 1e300, -1e300, 1e-300, math.inf, -math.inf, math.nan, None, 1.0000005, 2.5e-6, 0.1234565, -0.1234565]
    df = spark.createDataFrame([(x,) for x in near + far + odd], "x double")
    got = df.select("x", rounded("x").alias("a"), (F.round("x", 6) + F.lit(0.0)).alias("b")).collect()
    for row in got:
        assert (row.a is None) == (row.b is None) == (row.x is None)
        assert row.a is None or repr(row.a) == repr(row.b), row


def test_chunks_are_written_and_read_by_compiled_methods(spark, tmp_path, monkeypatch):
    """One method for a stage of 93 columns is too large for the JVM to compile: neither the write nor the last step runs in one. The session's own setting comes back."""
    before, made, write = spark.conf.get(LIMIT), [], chunks.chunk_features

    def seen(*args):
        df = write(*args)
        monkeypatch.setattr(type(df.write), "partitionBy", lambda self, *names, f=type(df.write).partitionBy: made.append(spark.conf.get(LIMIT)) or f(self, *names))
        return df

    monkeypatch.setattr(chunks, "chunk_features", seen)
    grid = pipeline.excluded(spark, "/root/testdata/sf0.001").where("market_id < 3")
    chunks.build_chunks(grid, pipeline.markets(spark, "/root/testdata/sf0.001"), str(tmp_path / "out"), ChunkConfig(days=7, minutes=60), FeatureConfig.low_memory())
    assert made and int(made[0]) <= 8000 and spark.conf.get(LIMIT) == before
    out = queries.tidy_wide(spark.read.parquet(str(tmp_path / "out")).drop("question", "close_time"), queries.INFINITE, 1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert next(line for line in plan if "Project" in line).lstrip(" :+-").startswith("Project")  # no *(1)


def test_wide_rows_are_tidied_like_others(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(hours=i), x, x, i) for i, x in enumerate([0.25, 1.5e-6, -1e-9, -0.0, math.inf, -math.inf, math.nan, None, 123.4565005])]
    df = spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, a double, b double, n int")
    want = queries.tidy(df, ("a",), lift=1e-12)
    got = queries.tidy_wide(df, ("a",), 1e-12)
    assert got.dtypes == want.dtypes
    plain = want.select(*((F.col(c) + F.lit(0.0)).alias(c) if kind == "double" else c for c, kind in want.dtypes))
    assert [repr(x) for x in got.orderBy("market_id").collect()] == [repr(x) for x in plain.orderBy("market_id").collect()]


def test_model_queries_train_the_whole_model(spark, monkeypatch):
    """They fit the reference's trees, as many as validation asks for: neither fewer, nor flatter, nor with smaller leaves."""
    seen = []
    monkeypatch.setattr(queries.model, "train", lambda df, names, cfg: seen.append((df.count(), len(names), cfg)))
    df, _ = queries._model(spark, "/root/testdata/sf0.01")
    (rows, features, cfg) = seen[0]
    assert rows == pipeline.split(spark, "/root/testdata/sf0.01").count() == df.count() and features > 90
    assert (cfg.max_trees, cfg.depth, cfg.min_leaf, cfg.learning_rate, cfg.row_share, cfg.column_share, cfg.patience) == (5000, 7, 50, 0.05, 0.8, "0.8", 50)
