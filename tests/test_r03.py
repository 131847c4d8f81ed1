"""What the third review found."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest

from tidemark.config import BacktestConfig, ChunkConfig
from tidemark.operators import backtest, chunks, features, gaps, labels, strategies
from tidemark.plans import pipeline, queries
from tidemark.streaming import live


def test_json_is_parsed_once(spark):
    """Conditions on the parsed fields stay behind the parse, instead of repeating it for each mention."""
    lines = spark.createDataFrame([(json.dumps({"timestamp": str(t), "price": "0.5", "size": "2", "token_id": "a", "hash": f"h{t}"}),) for t in (1, 2, 0)] + [("no json",), (None,)], "value string")
    out = live.parse_trades(lines)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert sorted((x.timestamp, x.price, x.usd_amount, x.tx_hash) for x in out.collect()) == [(1, 0.5, 1.0, "h1"), (2, 0.5, 1.0, "h2")]


@pytest.mark.parametrize("most", [0, 1, 3])
def test_long_gaps_need_no_other_sort(spark, most):
    """Rows are flagged by rows that far away in the market's own order."""
    shapes = {1: "xooooxooxooo", 2: "oooox", 3: "x", 4: "xoooooooo", 5: "oo"}
    start = datetime(2024, 1, 1)
    rows = [(m, start + timedelta(hours=i), c == "o") for m, shape in shapes.items() for i, c in enumerate(shape)]
    out = gaps.flag_long_gaps(spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, is_empty_bucket boolean"), most)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    found = {(x.market_id, x.bucket_time): x.in_long_gap for x in out.collect()}
    for m, shape in shapes.items():
        for i, c in enumerate(shape):
            at, left = len(shape[: i + 1]) - len(shape[: i + 1].rstrip("o")), len(shape[i:]) - len(shape[i:].lstrip("o"))
            assert found[m, start + timedelta(hours=i)] == (c == "o" and max(at, left) > most), (m, i)


def test_grid_tasks_grow_with_events(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "EVENTS", 100)
    assert pipeline.filled(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 10


def test_feature_sums_make_no_row_for_each_value(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None), (2.0, None), (float("nan"), None)], "a double, b double")
    out = queries._known(df)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.feature, x.known, x.mean) for x in out.collect()) == [("a", 2, 1.5), ("b", 0, None)]


def test_chunks_are_written_once(spark, monkeypatch, tmp_path):
    """Features go to their table from the tasks that made them: no table between, no second shuffle of all columns."""
    grid = pipeline.excluded(spark, "/root/testdata/sf0.001")
    grid.write.parquet(str(tmp_path / "grid"))
    grid, made = spark.read.parquet(str(tmp_path / "grid")), []
    whole = chunks.chunk_features
    monkeypatch.setattr(chunks, "chunk_features", lambda *a: made.append(whole(*a)) or made[-1])
    monkeypatch.setattr("tidemark.functions.shared.shared_path", lambda *a: 1 / 0)
    assert chunks.build_chunks(grid, pipeline.markets(spark, "/root/testdata/sf0.001"), str(tmp_path / "out"), ChunkConfig(days=7, minutes=60), tasks=3)
    assert made[0].rdd.getNumPartitions() == 3
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == grid.count() == table.select("market_id", "bucket_time").distinct().count()


def test_chunked_features_are_rounded_once(spark):
    """Rounding goes through decimals, so that it isn't repeated for each mention."""
    out = queries.feature_chunks(spark, "/root/testdata/sf0.001")
    doubles = sum(kind == "double" for _, kind in out.dtypes)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("round(") <= doubles


def test_windows_of_strategies_are_added_in_order(spark):
    """Conditions and bins decide on a sum's last bit, so it is that of the rows in their order."""
    start, price = datetime(2024, 1, 1), [((i * 37) % 100 + 0.5) / 100.0 for i in range(200)]
    rows = [(m, start + timedelta(hours=i), p, 7.1 * p, 1, p / 3) for m in (1, 2) for i, p in enumerate(price)] + [(3, start + timedelta(hours=i), None if i == 30 else 0.5, 1.0, 1, 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, mean_price double, total_usd double, trade_count long, momentum double")
    cfg = strategies.FEATURES
    got = features.rolling_features(df, cfg.windows, cfg.in_order).orderBy("market_id", "bucket_time").collect()
    for i, x in enumerate(got[:200]):
        price_sum = usd_sum = 0.0
        for p in price[max(0, i - 23) : i + 1]:
            price_sum, usd_sum = price_sum + p, usd_sum + 7.1 * p
        assert (x.price_ma24, x.volume_sum24) == ((price_sum / 24.0, usd_sum) if i >= 23 else (None, None))
        assert (x.price_std24 is None) == (i < 23)
    assert [x.price_ma24 is None for x in got[400:]] == [i < 23 or 30 <= i < 54 for i in range(60)]
    whole = features.rolling_features(df, cfg.windows).orderBy("market_id", "bucket_time").collect()
    assert [x.price_std24 for x in got] == pytest.approx([x.price_std24 for x in whole])


def test_backtest_adds_up_in_order(spark):
    """The bankroll is that of the plain fold in every bit, across chunks, also where it starts low and where it has grown."""
    cfg, draw = BacktestConfig(), random.Random(11)
    plays = {k: [float(draw.random() < share) for _ in range(n)] for k, n, share in (("long", 60_000, 0.8), ("low", 3_000, 0.515), ("bust", 500, 0.3))}
    df = spark.createDataFrame([(k, i, y, 0.6) for k, ys in plays.items() for i, y in enumerate(ys)], "k string, i long, y double, p double")
    got = backtest.backtest(df, ["k"], ["i"], cfg, chunk=512).orderBy("k", "seq").collect()
    for k, ys in plays.items():
        bank = peak = cfg.bankroll
        want = []
        for y in ys:
            stake = min(cfg.max_position, bank * 0.5)
            if stake >= 1 and bank >= 10:
                bank += stake * (1.0 - cfg.fee) if y == 1 else -stake
                peak = max(peak, bank)
                want.append((bank, peak))
        assert [(x.equity, x.peak) for x in got if x.k == k] == want
    totals = {x.k: x.total_pnl for x in backtest.backtest_summary(spark.createDataFrame(got).repartition(5), ["k"], cfg).collect()}
    for k in plays:
        total = 0.0
        for x in got:
            total += x.pnl if x.k == k else 0.0
        assert totals[k] == total


def test_features_are_made_for_labeled_rows_only(spark):
    """The filter on labels gets down to the windows, below the join with markets and all ratios, and the split reads rows made once."""
    df = labels.trainable(pipeline.dataset(spark, "/root/testdata/sf0.001"))
    assert df.columns[-3:] == ["future_price", "future_return", "win"]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = {what: next(i for i, line in enumerate(plan) if what in line) for what in ("Join", "Filter (isnotnull(win", "Window")}
    assert first["Join"] < first["Filter (isnotnull(win"] < first["Window"]
    split = pipeline.split(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in split and "explode(" not in split
