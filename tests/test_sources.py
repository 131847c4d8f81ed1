import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import ChunkConfig, FeatureConfig, ModelConfig, SourceConfig
from tidemark.functions.numeric import sigmoid
from tidemark.operators import chunks, features, gaps, labels, model, normalize, splits
from tidemark.plans import pipeline
from tidemark.sources import convert, readers, runlog
from tidemark.streaming import live

T0 = datetime(2024, 1, 1)


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("price,side,market_id,token_amount,usd_amount,timestamp,direction\n0.5,token1,3,20,10,2024-01-01 00:00:01,BUY\nx,token2,4,1,,2024-01-01 00:00:02,SELL\n")
    cfg = SourceConfig(trades_path=str(tmp_path / "t.csv"), format="csv")
    rows = readers.load_trades(spark, cfg).orderBy("market_id").collect()
    assert [(x.market_id, x.is_yes, x.price, x.usd_amount, x.is_buy) for x in rows] == [(3, 1, 0.5, 10.0, 1), (4, 0, None, None, 0)]
    renamed = SourceConfig(trades_path=str(tmp_path / "r.csv"), format="csv", columns={**cfg.columns, "timestamp": "time", "usd_amount": "paid"})
    (tmp_path / "r.csv").write_text("time,paid,market_id,side,price,token_amount\n2024-01-01 00:00:01,10,3,token1,0.5,20\n")
    assert readers.load_trades(spark, renamed).first().usd_amount == 10.0
    (tmp_path / "m.csv").write_text("id,question,volume,closedTime\n1,q,5,2024-01-01\n")
    got = readers.load_markets(spark, SourceConfig(markets_path=str(tmp_path / "m.csv"), format="csv")).first()
    assert (got.market_id, got.volume, got.yes_price) == (1, 5.0, None)
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", SourceConfig(format="orc"))


def test_csv_files_have_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "1.csv").write_text("timestamp,market_id,side,price,usd_amount,token_amount\n2024-01-01 00:00:01,1,token1,0.5,100,200\n")
    (folder / "2.csv").write_text('price,"market_id",usd_amount,extra,timestamp,side,token_amount,price\n0.25,2,50,"x,y",2024-01-01 00:00:02,token2,200,9\n')
    (folder / "3.csv").write_text("market_id,timestamp,side,price,usd_amount\n3,2024-01-01 00:00:03,token1,0.75,75\n")
    (folder / "4.csv").write_text("")
    (folder / "5.csv").write_text("timestamp,market_id,side,price,usd_amount,token_amount\n")
    cfg = SourceConfig(trades_path=str(folder), format="csv")
    got = readers.load_trades(spark, cfg).orderBy("market_id").collect()
    assert [(x.market_id, x.is_yes, x.price, x.usd_amount, x.token_amount, x.timestamp.second) for x in got] == [(1, 1, 0.5, 100.0, 200.0, 1), (2, 0, 0.25, 50.0, 200.0, 2), (3, 1, 0.75, 75.0, None, 3)]
    raw = readers.read_csv(spark, str(folder)).orderBy("market_id").collect()
    assert [x.extra for x in raw] == [None, "x,y", None]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "1.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "none"), "a long").count() == 0


def test_sinks_are_clustered(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).select((F.col("id") * 7919 % 50).alias("market_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 31 % 14_400).cast("int"))).alias("bucket_time"), F.col("id").alias("v"))
    df = df.withColumn("day", F.to_date("bucket_time")).repartition(7)
    readers.write_table(df, str(tmp_path / "out"), partition_by=("day",), files=4)
    days = sorted((tmp_path / "out").glob("day=*"))
    assert len(days) == 10
    for day in days:
        files = sorted(day.glob("*.parquet"))
        assert 1 <= len(files) <= 2
        for file in files:
            rows = [(x["market_id"], x["bucket_time"]) for x in pq.read_table(file, partitioning=None).to_pylist()]
            assert rows == sorted(rows)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20_000
    plain = readers.cached(spark, df.limit(3), str(tmp_path / "copy"))
    assert plain.count() == 3 and readers.cached(spark, df, str(tmp_path / "copy")).count() == 3
    (tmp_path / "copy" / "_SUCCESS").unlink()
    assert readers.cached(spark, df, str(tmp_path / "copy")).count() == 20_000
    assert readers.cached(spark, df.drop("v"), str(tmp_path / "copy")).columns == ["market_id", "bucket_time", "day"]


def test_sinks_copies_and_history(spark, tmp_path):
    df = spark.createDataFrame([(2, T0, 0.5), (1, T0, 0.25), (1, T0 + timedelta(minutes=5), 0.75)], "market_id long, bucket_time timestamp_ntz, mean_price double")
    readers.write_table(df.coalesce(1), str(tmp_path / "out"), "zstd")
    assert [x.mean_price for x in spark.read.parquet(str(tmp_path / "out")).collect()] == [0.25, 0.75, 0.5]
    readers.write_table(df, str(tmp_path / "parts"), "gzip", ("market_id",))
    assert (tmp_path / "parts" / "market_id=1").exists()
    first = readers.cached(spark, df, str(tmp_path / "copy"))
    assert first.count() == 3 and readers.cached(spark, df.limit(0), str(tmp_path / "copy")).count() == 3
    store = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("b", 9, "z")], "token_id string, timestamp long, tx_hash string")
    assert [x.tx_hash for x in readers.history(store, "a", 3).collect()] == ["y", "x"]
    none = readers.history(store, "c", 0)
    assert none.count() == 0 and none.columns == store.columns
    assert readers.lookback(df, T0 + timedelta(minutes=5), 1, 5, "bucket_time").count() == 3
    assert splits.time_range(df, T0, T0).count() == 2


def test_run_log_may_be_missing_or_broken(spark, tmp_path):
    assert runlog.read_log(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"type": "model", "ts": "1"}\nbroken\n{"type": "model", "ts": "2"}\n')
    assert [x.ts for x in runlog.run_history(runlog.read_log(spark, str(tmp_path / "log")), 1).collect()] == ["2"]
    (tmp_path / "log" / "b.json").write_text('{"type": "model", "ts": "2", "trades": 9}\n{"type": "model", "ts": "2", "trades": 8}\n')
    assert [x.trades for x in runlog.run_history(runlog.read_log(spark, str(tmp_path / "log")).where("trades is not null"), 1).collect()] == [8]


def test_markets_from_strings(spark):
    rows = [(" 7 ", None, "1.5", "2024-01-02T03:04:05Z"), ("x", " q ", "many", "2024-01-02")]
    raw = spark.createDataFrame([(*r, None, None, None, None, "t", None) for r in rows], "id string, question string, volume string, closedTime string, answer1 string, answer2 string, market_slug string, ticker string, token1 string, token2 string")
    a, b = convert.convert_markets(raw).orderBy(F.col("market_id").desc_nulls_last()).collect()
    assert (a.market_id, a.question, a.volume, a.token1, a.token2, a.yes_price) == (7, "", 1.5, "t", "", None) and a.close_time is not None
    assert (b.market_id, b.question, b.volume, b.close_time) == (None, "q", None, None)


def test_align_fills_what_is_missing(spark):
    row = normalize.align(spark.createDataFrame([(1, 2)], "a int, b int"), ["b", "c"]).first()
    assert row.b == 2.0 and row.c != row.c and len(row) == 2


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 12, 24, 48])
def test_rolling_windows_of_any_length(spark, n):
    values = [None if i in (9, 70) else (i * 37 % 11) / 7 for i in range(130)]
    rows = [(m, T0 + timedelta(minutes=5 * i), v, 1.0 * i, i % 3, v, 0.5) for m in (1, 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, mean_price double, total_usd double, trade_count long, momentum double, yes_ratio double").repartition(3)
    got = [x for x in features.rolling_features(df, (n,)).orderBy("market_id", "bucket_time").collect() if x.market_id == 2]
    for i, x in enumerate(got):
        window = values[max(0, i - n + 1) : i + 1]
        if len(window) < n or None in window:
            assert x[f"price_ma{n}"] is None and x[f"price_std{n}"] is None
        else:
            mean = sum(window) / n
            assert x[f"price_ma{n}"] == pytest.approx(mean)
            assert n == 1 or x[f"price_std{n}"] == pytest.approx((sum((v - mean) ** 2 for v in window) / (n - 1)) ** 0.5, abs=1e-9)
        assert x[f"volume_sum{n}"] == (None if i < n - 1 else pytest.approx(sum(range(i - n + 1, i + 1))))


def buckets(spark, markets=4, n=260):
    rows = [(m, T0 + timedelta(minutes=5 * i), 3, 10.0 + i % 7, 20.0, 0.5, 0.5, 0.6, 0.4, 0.5 + 0.01 * ((i * (m + 3)) % 13), 0.7 if i % 2 else 0.3, 0, 0.0, 0.5, 0.01 * (i % 5)) for m in range(markets) for i in range(n) if i % 9]
    return spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, trade_count long, total_usd double, total_tokens double, open_price double, close_price double, high_price double, low_price double, mean_price double, yes_ratio double, whale_count long, whale_usd double, vwap double, momentum double")


def market_table(spark, markets=4):
    return spark.createDataFrame([(m, 0.5, 0.5, 100.0, 10.0, T0 + timedelta(days=9)) for m in range(markets)], "market_id long, yes_price float, no_price float, volume float, liquidity float, close_time timestamp_ntz")


def test_gap_fill_carries_over_nulls_and_drops_what_has_no_place(spark):
    kind = "market_id long, bucket_time timestamp_ntz, trade_count long, whale_count long, total_usd double, total_tokens double, whale_usd double, open_price double, close_price double, high_price double, low_price double, mean_price double, vwap double, momentum double, yes_ratio double"
    row = lambda m, at, price: (m, at, 1, 0, 5.0, 1.0, 0.0, *[price] * 7, 1.0)
    df = spark.createDataFrame([row(1, T0, 0.5), row(1, T0 + timedelta(minutes=10), None), row(1, T0 + timedelta(minutes=20), 0.7), row(2, T0, 0.1), row(None, T0, 0.1), row(3, None, 0.1)], kind)
    got = gaps.fill_buckets(df, 5).orderBy("market_id", "bucket_time").collect()
    assert [(x.market_id, x.mean_price, x.trade_count, x.yes_ratio, x.is_empty_bucket) for x in got] == [(1, 0.5, 1, 1.0, False), (1, 0.5, 0, 0.5, True), (1, 0.5, 1, 1.0, False), (1, 0.5, 0, 0.5, True), (1, 0.7, 1, 1.0, False), (2, 0.1, 1, 1.0, False)]


def test_gap_fill_keeps_repeated_rows_and_drops_rows_off_the_grid(spark):
    kind = "market_id long, bucket_time timestamp_ntz, trade_count long, whale_count long, total_usd double, total_tokens double, whale_usd double, open_price double, close_price double, high_price double, low_price double, mean_price double, vwap double, momentum double, yes_ratio double"
    row = lambda m, at, price: (m, T0 + timedelta(minutes=at), 1, 0, 5.0, 1.0, 0.0, *[price] * 7, 1.0)
    table = [row(1, 0, 0.5), row(1, 5, 0.6), row(1, 5, 0.6), row(1, 20, 0.7), row(2, 1, 0.1), row(2, 4, 0.9), row(2, 8, 0.9), row(2, 13, 0.9), row(2, 14, 0.9), row(2, 16, 0.2), row(2, 24, 0.9), row(3, 0, 0.1), row(3, 7, 0.9), row(3, 12, 0.9)]
    got = gaps.fill_buckets(spark.createDataFrame(table, kind).repartition(3), 5).orderBy("market_id", "bucket_time").collect()
    shown = [(x.market_id, (x.bucket_time - T0).seconds // 60, x.mean_price, x.trade_count) for x in got]
    assert shown == [(1, 0, 0.5, 1), (1, 5, 0.6, 1), (1, 5, 0.6, 1), (1, 10, 0.6, 0), (1, 15, 0.6, 0), (1, 20, 0.7, 1), (2, 1, 0.1, 1), (2, 6, 0.1, 0), (2, 11, 0.1, 0), (2, 16, 0.2, 1), (2, 21, 0.2, 0), (3, 0, 0.1, 1), (3, 5, 0.1, 0), (3, 10, 0.1, 0)]


def test_a_model_is_trained_stopped_early_stored_and_scored(spark, tmp_path):
    filled = gaps.apply_gap_exclusions(gaps.flag_long_gaps(gaps.fill_buckets(buckets(spark), 5)))
    df = splits.walk_forward_split(labels.add_labels(features.build_features(filled, market_table(spark), FeatureConfig.low_memory()))).cache()
    names = [c for c in features.feature_columns(df) if c not in ("position", "question")]
    assert "price_ma12" in names and "price_ma24" not in names and "mean_price_lag2" not in names
    fitted = model.train(df, names, ModelConfig(max_trees=8, depth=3, min_leaf=5))
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    rows = model.score(again, df.withColumn("mean_price", F.when(F.col("position") % 5 == 0, float("nan")).otherwise(F.col("mean_price"))).drop("hour"))
    p = [x.p for x in rows.select("p").collect()]
    assert len(p) == df.count() and all(0 <= x <= 1 for x in p)
    assert model.model_features(again) == names
    top = model.importance(fitted, df, 5).collect()
    assert len(top) == 5 and [x.gain for x in top] == sorted((x.gain for x in top), reverse=True)
    scores = {x.split: x.auc for x in model.evaluate(model.score(fitted, df)).collect()}
    assert set(scores) == {"train", "validation", "test"} and scores["train"] > 0.6
    assert fitted.stages[-1].getNumTrees <= 8


def played(spark, n=900, noise=0.3):
    """Rows whose win follows x, but for noise; y has holes exactly where the win is turned."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x, gone = rng.random(), i % 3 == 0
        win = int(x > 0.5) if rng.random() > noise else rng.randint(0, 1)
        rows.append((x, [None, math.nan, math.inf][i // 3 % 3] if gone else model.MISSING + rng.uniform(-4, 4), 1 - win if gone else win, "train" if i < n * 0.6 else "validation" if i < n * 0.8 else "test"))
    return spark.createDataFrame(rows, "x double, y double, win int, split string").cache()


def test_best_iteration_waits_for_its_patience():
    losses = [5.0, 4.0, 4.5, 4.2, 3.0, 3.5, 3.1, 3.2, 2.0]
    assert model.best_iteration(losses, 3) == (4, True)
    assert model.best_iteration(losses, 2) == (1, True)
    assert model.best_iteration(losses, 5) == (8, False)
    assert model.best_iteration([1.0, 1.0, 1.0], 2) == (0, True)


def test_training_stops_by_patience_and_keeps_the_best_trees(spark, tmp_path, monkeypatch):
    df = played(spark, noise=0.5)
    kind = {"depth": 2, "min_leaf": 5, "learning_rate": 0.1}
    fitted = model.train(df, ["x", "y"], ModelConfig(max_trees=32, patience=3, **kind))
    kept = fitted.stages[-1].getNumTrees
    with monkeypatch.context() as m:
        m.setattr(model, "first_trees", lambda fitted, n: fitted)  # nothing is cut off
        every = model.curve(model.train(df, ["x", "y"], ModelConfig(max_trees=32, patience=32, **kind)), df)
    assert len(every) == 32 and kept - 1 == model.best_iteration(every, 3)[0] and 1 < kept < 24  # it was found with 24 trees
    assert every[kept - 1] == min(every[: kept + 3]) and every[kept - 1] > min(every)
    assert model.curve(fitted, df) == pytest.approx(every[:kept])
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    assert again.stages[-1].getNumTrees == kept
    assert [x.p for x in model.score(again, df).orderBy("x").collect()] == [x.p for x in model.score(fitted, df).orderBy("x").collect()]


def test_missing_values_split_off_from_small_ones(spark, tmp_path):
    df = played(spark)
    fitted = model.train(df, ["x", "y"], ModelConfig(max_trees=12, patience=12, depth=3, min_leaf=5, column_share="all"))
    gains = {x.feature: x.gain for x in model.importance(fitted, df).collect()}
    assert set(gains) == {"x", "y", "y_missing"} and gains["y_missing"] > gains["y"]  # x has no holes, and so no indicator
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    p = {}
    for name, value in {"null": None, "nan": math.nan, "inf": math.inf, "less": -math.inf, "small": -1e9, "sentinel": model.MISSING}.items():
        p[name] = model.score(again, spark.createDataFrame([(0.9, value)], "x double, y double")).first().p
    assert p["null"] == p["nan"] == p["inf"] == p["less"] < 0.5 < min(p["small"], p["sentinel"])
    assert model.score(again, spark.createDataFrame([(0.9,)], "x double")).first().p == p["null"]


def test_training_without_validation_rows_keeps_all_trees(spark):
    fitted = model.train(played(spark).where("split <> 'validation'"), ["x"], ModelConfig(max_trees=4, depth=2, min_leaf=5))
    assert fitted.stages[-1].getNumTrees == 4


def test_chunks_of_features_equal_the_whole(spark, tmp_path):
    grid = gaps.fill_buckets(buckets(spark), 5).withColumns({"in_long_gap": F.lit(False), "exclude_from_training": F.lit(False)}).cache()
    cfg, path = ChunkConfig(days=1, origin=T0 - timedelta(hours=17)), str(tmp_path / "f")
    cfg = ChunkConfig(days=1, origin=cfg.origin, context=60)
    table = market_table(spark)
    early = grid.where(F.col("bucket_time") < T0 + timedelta(hours=9))
    assert chunks.build_chunks(early, table, path, cfg) == [0, 1]  # the second one is cut off
    assert chunks.build_chunks(grid, table, path, cfg) == [1]
    assert chunks.build_chunks(grid, table, path, cfg) == [1] and chunks.known_chunks(grid, path) == [0, 1]
    whole = features.build_features(grid, table)
    got = spark.read.parquet(path)
    assert got.groupBy("chunk_id").count().count() == 2 and grid.count() == got.count()
    got = got.select(*whole.columns)
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0


def test_a_chunk_is_built_anew_alone(spark, tmp_path):
    grid = gaps.fill_buckets(buckets(spark, n=900), 5).cache()
    cfg, path, table = ChunkConfig(days=1, origin=T0), str(tmp_path / "f"), market_table(spark)
    assert chunks.build_chunks(grid, table, path, cfg) == [0, 1, 2, 3]
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "f").rglob("*.parquet"))}
    changed = grid.withColumn("total_usd", F.when((F.col("bucket_time") >= T0 + timedelta(days=1)) & (F.col("bucket_time") < T0 + timedelta(days=2)), F.col("total_usd") * 2).otherwise(F.col("total_usd")))
    assert chunks.build_chunks(changed, table, path, cfg, chunks=[1, 2]) == [1, 2]
    after = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "f").rglob("*.parquet"))}
    same = [f for f in before if after.get(f) == before[f]]
    assert {f.split("chunk_id=")[1][0] for f in same} == {"0", "3"} and {f.split("chunk_id=")[1][0] for f in set(after) - set(same)} == {"1", "2"}
    whole = features.build_features(changed, table)
    got = spark.read.parquet(path).select(*whole.columns)
    assert got.exceptAll(whole).count() == 0 and got.count() == whole.count()
    with pytest.raises(ValueError):
        chunks.chunk_features(grid, table, [0], ChunkConfig(context=20))
    assert chunks.runs([5, 1, 2, 2, 7, 6]) == [(1, 2), (5, 7)]


def test_late_trades_are_told_from_stored_ones(spark):
    kind = "token_id string, timestamp long, price double, usd_amount double, token_amount double, is_yes int, tx_hash string"
    row = lambda token, at, tx: (token, at, 0.5, 1.0, 2.0, 1, tx)
    store = spark.createDataFrame([row("a", 10, "h1"), row("a", 20, "h2"), row("b", 10, "h1"), row("b", 5, None)], kind)
    batch = spark.createDataFrame([row("a", 20, "h2"), row("a", 20, "h3"), row("a", 4, "h0"), row("a", 30, "h4"), row("a", 30, "h4"), row("c", 10, "h1"), row("b", 5, None), row(None, 1, "h9")], kind)
    got = sorted((x.token_id or "", x.timestamp, x.tx_hash or "") for x in live.unseen(batch, store).collect())
    assert got == [("", 1, "h9"), ("a", 4, "h0"), ("a", 20, "h3"), ("a", 30, "h4"), ("b", 5, ""), ("c", 10, "h1")]
    assert {x.tx_hash for x in live.newer(batch.where("token_id = 'a'"), store).collect()} == {"h4"}
    assert live.unseen(batch, store.where("false")).count() == 7 and live.unseen(batch.where("false"), store).count() == 0


def test_scored_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    """Three micro-batches, the second of which fails once: each gives its signals once, as the batch decision on all that came so far."""
    table, markets = buckets(spark, 3, 150).cache(), market_table(spark, 3)
    cuts = [T0 + timedelta(minutes=5 * n) for n in (0, 60, 90, 150)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = table.where((F.col("bucket_time") >= F.lit(a).cast("timestamp_ntz")) & (F.col("bucket_time") < F.lit(b).cast("timestamp_ntz")))
        part = part.where("market_id < 2") if n == 1 else part  # the third market is not touched
        part.coalesce(1).write.parquet(str(tmp_path / f"parts{n}"))
    (tmp_path / "in").mkdir()
    failed = []

    def score(df):
        if len(list((tmp_path / "in").glob("*"))) == 2 and not failed:
            failed.append(1)
            raise RuntimeError("once")
        return df.withColumn("p", sigmoid(F.col("price_change_lag1") * 20))

    def run():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), markets, score, 0.5).awaitTermination()

    seen = []
    for n in range(3):
        file = next((tmp_path / f"parts{n}").glob("*.parquet"))
        file.rename(tmp_path / "in" / f"{n}.parquet")
        if n == 1:
            with pytest.raises(Exception, match="once"):
                run()
        run()
        arrived = table.where(F.col("bucket_time") < F.lit(cuts[n + 1]).cast("timestamp_ntz"))
        arrived = arrived.where(~((F.col("market_id") == 2) & F.col("bucket_time").between(F.lit(cuts[1]).cast("timestamp_ntz"), F.lit(cuts[2] - timedelta(minutes=1)).cast("timestamp_ntz"))))
        touched = {0, 1} if n == 1 else {0, 1, 2}
        want = {(x.market_id, x.bucket_time, x.signal, round(x.p, 9)) for x in live.latest_signal(arrived, markets, lambda df: df.withColumn("p", sigmoid(F.col("price_change_lag1") * 20)), 0.5).collect() if x.market_id in touched}
        rows = spark.read.parquet(str(tmp_path / "out")).where(F.col("batch") > max(seen, default=-1)).collect()  # batches without data come between
        got = [(x.market_id, x.bucket_time, x.signal, round(x.p, 9)) for x in rows]
        seen += [x.batch for x in rows]
        assert set(got) == want and len(got) == len(want)
    assert failed and spark.read.parquet(str(tmp_path / "out")).count() == len(seen) == 8
    table.unpersist()


def test_state_keeps_the_last_buckets_only(spark, tmp_path):
    table = buckets(spark, 2, 200)
    (tmp_path / "in").mkdir()
    table.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "in" / "0.parquet")
    again = table.where("market_id = 1").orderBy(F.desc("bucket_time")).limit(1).withColumn("mean_price", F.lit(0.123))
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    keep = lambda df, n: got.append([(x.market_id, x.bucket_time, x.mean_price, x.trade_count) for x in df.collect()])
    start = lambda: live.rings(stream(), 10, 5).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    start()
    again.coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("*.parquet")).rename(tmp_path / "in" / "1.parquet")
    start()
    first, second = [x for x in got if x]
    newest = max(x[1] for x in first)
    want = [(x.market_id, x.bucket_time, x.mean_price, x.trade_count) for x in table.collect() if x.bucket_time > newest - timedelta(minutes=50)]
    assert sorted(first) == sorted(want)
    assert sorted(second) == sorted((m, t, 0.123 if t == newest else p, c) for m, t, p, c in want if m == 1)


def trade_lines(n, start=1704067200, step=40, tag="h"):
    return [f'{{"timestamp": {start + step * i}, "price": "0.{i % 9 + 1}", "size": "10", "outcome": "YES", "token_id": "t{i % 2}", "hash": "{tag}{i}"}}' for i in range(n)]


def test_closed_buckets_of_a_stream_equal_the_batch(spark, tmp_path):
    """Four files in order of time, the third with a repeat within the watermark and a trade that is far too late."""
    lines = trade_lines(400)
    (tmp_path / "in").mkdir()
    for n in range(4):
        some = lines[100 * n : 100 * n + 100] + ([lines[195], '{"timestamp": 1704067205, "price": "0.9", "size": "10", "token_id": "t1", "hash": "late"}'] if n == 2 else [])
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(some))
        __import__("os").utime(tmp_path / "in" / f"{n}.json", (1700000000 + n, 1700000000 + n))
    query = live.bucket_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=1)
    query.awaitTermination()
    states = [[s["numRowsTotal"] for s in p["stateOperators"]] for p in query.recentProgress]
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) >= 1
    assert max(s[0] for s in states) <= 40  # buckets that are open, of 107 that there were
    got = {(x.token_id, x.bucket_time): (x.trade_count, x.open_price, x.close_price, round(x.vwap, 9)) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    trades = live.parse_trades(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = trades.withColumn("event_time", F.timestamp_seconds("timestamp"))
    want = {(x.token_id, x.bucket_time): (x.trade_count, x.open_price, x.close_price, round(x.vwap, 9)) for x in live.stream_buckets(rows, tiebreak="tx_hash").collect()}
    closed = datetime(2024, 1, 1) + timedelta(seconds=399 * 40 - 600)
    assert got == {k: v for k, v in want.items() if k[1] + timedelta(minutes=5) <= closed} and len(got) > 80


def test_compaction_drops_rewrites_and_leaves_dates(spark, tmp_path):
    for n, lines in enumerate([*(trade_lines(40, 1704067200 + 7 * n, 7200, f"h{n}-") for n in range(3)), trade_lines(3, 1704067200 + 86400 * 5, 60, "new")]):  # as micro-batches write them
        trades = live.parse_trades(spark.createDataFrame([(x,) for x in lines], "value string")).coalesce(1)
        trades.withColumns({"date": F.to_date(F.timestamp_seconds("timestamp")), "batch": F.lit(n)}).write.mode("append").partitionBy("date", "batch").parquet(str(tmp_path / "out"))
    store, now = str(tmp_path / "out"), datetime(2024, 1, 6, 6)
    before = spark.read.parquet(store)
    dates = lambda: {x.name: sorted((y.name, y.stat().st_mtime_ns) for y in x.rglob("*.parquet")) for x in (tmp_path / "out").glob("date=*")}
    kept = {tuple(x) for x in live.prune(before, 3, now).select(*live.STORE).collect()}
    rows, files = before.count(), dates()
    assert rows == 123 and len(files) == 5 and len(files["date=2024-01-03"]) == 3 and len(files["date=2024-01-06"]) == 1
    assert live.compact(spark, store, 3, now) == {"dropped": 2, "rewritten": 2}
    after = dates()
    assert set(after) == {"date=2024-01-03", "date=2024-01-04", "date=2024-01-06"} and all(len(x) == 1 for x in after.values())
    assert after["date=2024-01-06"] == files["date=2024-01-06"]  # untouched
    got = [tuple(x) for x in spark.read.parquet(store).select(*live.STORE).collect()]
    assert set(got) == kept and len(got) == len(kept)
    assert live.compact(spark, store, 3, now)["dropped"] == 0 and spark.read.parquet(store).count() == len(kept)


def test_stages_may_be_kept(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("event_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 31).cast("int"))).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"), F.lit(5.0).alias("value"), F.format_string('{"k": %d}', F.col("id") % 90).alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(3).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(7.0).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    kept = pipeline.stages(spark, str(tmp_path), str(tmp_path / "keep"))
    plain = pipeline.stages(spark, str(tmp_path))
    assert list(kept) == ["bucketed", "filled", "features", "labeled"] and all((tmp_path / "keep" / k).exists() for k in kept)
    assert kept["labeled"].count() == plain["labeled"].count() > 200
