import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import BacktestConfig, SplitConfig
from tidemark.functions.numeric import parsed_time, ratio
from tidemark.operators import backtest, buckets, features, gaps, labels, metrics, normalize, splits, strategies
from tidemark.sources import convert
from tidemark.streaming import live

T0 = datetime(2024, 1, 1)


def grid(spark, empties):
    """One market: a trade, so many empty buckets, a trade."""
    rows = [(1, T0, False), *((1, T0 + timedelta(minutes=5 * (i + 1)), True) for i in range(empties)), (1, T0 + timedelta(minutes=5 * (empties + 1)), False)]
    return spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, is_empty_bucket boolean")


@pytest.mark.parametrize(("empties", "edge", "run"), [(60, [*range(1, 13), *range(49, 61)], 60), (48, [], 0), (95, [i for i in range(1, 96) if i != 48], 95), (96, list(range(1, 97)), 96)])
def test_long_gaps_by_edge_distance_and_by_run(spark, empties, edge, run):
    df = grid(spark, empties)
    got = [i for i, x in enumerate(gaps.flag_long_gaps(df).orderBy("bucket_time").collect()) if x.in_long_gap]
    assert got == edge
    assert gaps.flag_long_gaps(df, mode="run_length").where("in_long_gap").count() == run


def test_ratio_keeps_infinities(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 1.0)], "n double, d double")
    assert [x[0] for x in df.select(ratio("n", "d")).collect()] == [math.inf, -math.inf, None, 0.5, None]


def test_timestamps(spark):
    given = ["2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05 +00", "2024-01-02 03:04:05+01:00", "", "x", "2024-01-02", None]
    got = [x[0] for x in spark.createDataFrame([(g,) for g in given], "s string").select(parsed_time("s").cast("string")).collect()]
    assert got == ["2024-01-02 03:04:05.5", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 02:04:05", None, None, None, None]


def test_unknown_sides_and_null_prices(spark):
    raw = spark.createDataFrame([(T0, 1, "token1", None, 0.0, 0.0, 1), (T0 + timedelta(seconds=1), 1, "other", 0.4, 10.0, 25.0, 2), (T0 + timedelta(seconds=2), 1, None, 0.6, 2000.0, 10.0, 3)], "timestamp timestamp_ntz, market_id long, side string, price double, usd_amount double, token_amount double, id long")
    row = buckets.aggregate_trades(normalize.normalize_trades(raw, keep=("id",)), 5, tiebreak="id").first()
    assert row.yes_ratio == pytest.approx(-1 / 3)
    assert (row.open_price, row.close_price, row.mean_price) == (None, 0.6, 0.5)
    assert (row.whale_count, row.whale_usd) == (1, 2000.0)


def test_rolling_needs_full_windows_and_friday_is_weekend(spark):
    rows = [(1, datetime(2024, 1, 5) + timedelta(minutes=5 * i), None if i == 2 else 0.5, 1.0, 1, 0.0, 0.5) for i in range(9)]
    df = spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, mean_price double, total_usd double, trade_count long, momentum double, yes_ratio double")
    got = features.rolling_features(df, (6,)).orderBy("bucket_time").collect()
    assert [x.price_ma6 for x in got] == [None] * 8 + [0.5]
    assert [x.volume_sum6 for x in got] == [None] * 5 + [6.0] * 4
    assert features.time_features(df).first().is_weekend == 1


def test_labels_are_strict_and_mirrored(spark):
    moves = [(0.5, 0.501, 0.6, None), (0.5, 0.502, 0.6, 1), (0.5, 0.49, 0.6, 0), (0.5, 0.49, 0.4, 1), (0.5, 0.52, 0.5, 0)]
    rows = [(m, T0 + timedelta(minutes=5 * i), price if i == 0 else (later if i == 6 else 0.5), side, False, False) for m, (price, later, side, _) in enumerate(moves) for i in range(7)]
    df = spark.createDataFrame(rows, "market_id long, bucket_time timestamp_ntz, mean_price double, yes_ratio double, is_empty_bucket boolean, exclude_from_training boolean")
    got = labels.add_labels(df).where(F.col("bucket_time") == F.lit(T0).cast("timestamp_ntz")).orderBy("market_id").collect()
    assert [x.win for x in got] == [x[3] for x in moves]
    assert labels.add_labels(df).where("future_price is null").count() == 6 * len(moves)


def test_split_bounds():
    assert splits.split_bounds(3978) == (2778, 2796, 3386, 3398)
    assert splits.split_bounds(100) == (67, 76, 88, 94)
    with pytest.raises(ValueError):
        splits.split_bounds(40)


def test_walk_forward_split_is_ordered(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("market_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") / 3).cast("int"))).alias("bucket_time"), F.lit(1).alias("win"), F.lit(False).alias("exclude_from_training"))
    got = splits.walk_forward_split(df, SplitConfig()).orderBy("bucket_time", "market_id").collect()
    assert [x.position for x in got] == list(range(400))
    assert [k for k, _ in __import__("itertools").groupby(x.split for x in got if x.split)] == ["train", "validation", "test"]


def test_positions_over_days_equal_one_order(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("market_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(hours=((F.col("id") * 37) % 500).cast("int"))).alias("bucket_time")).distinct()
    got = [x.position for x in splits.positions(df).orderBy("bucket_time", "market_id").collect()]
    assert got == list(range(len(got))) and len(got) > 2000
    plan = splits.positions(df)._jdf.queryExecution().optimizedPlan().toString()
    single = [line for line in plan.splitlines() if "Window" in line and "__day" in line and "__base" not in line and "__total" in line]
    assert single  # the one window without a key is over totals of days


def test_auc_ties_only_equal_scores_unless_asked(spark):
    df = spark.createDataFrame([("a", 1.0, 0.3 + 1e-14), ("a", 0.0, 0.3)], "k string, y double, p double")
    assert metrics.roc_auc(df, ["k"]).first().auc == 1.0 and metrics.roc_auc(df, ["k"], 12).first().auc == 0.5


def test_auc_gives_half_for_ties_and_calibration_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 0.3), ("a", 0.0, 0.3), ("a", 1.0, 1.0), ("a", 0.0, 0.0)], "k string, y double, p double")
    assert metrics.roc_auc(df, ["k"]).first().auc == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    assert sorted(x.bin for x in metrics.calibration(df, ["k"]).collect()) == [0, 2]


@pytest.mark.parametrize("kelly", [False, True])
def test_backtest_is_a_fold_in_order(spark, kelly):
    cfg = BacktestConfig(kelly=kelly, bankroll=30.0, max_position=10.0)
    plays = [(i, (i * 7 % 5 > 2) * 1.0, 0.5 + (i % 7) / 14) for i in range(200)]
    bank, want = cfg.bankroll, []
    for i, y, p in plays:
        if p < cfg.threshold:
            continue
        odds = 1 - cfg.fee
        stake = min(bank * max(0, min((p * odds - (1 - p)) / odds, cfg.kelly_cap)) if kelly else cfg.max_position, cfg.max_position, bank / 2)
        if stake < 1 or bank < 10:
            continue
        bank += stake * odds if y == 1 else -stake
        want.append((i, bank))
    df = spark.createDataFrame([(s, *x) for x in plays for s in "ab"], "s string, i long, y double, p double").repartition(5)
    got = backtest.backtest(df, ["s"], ["i"], cfg).where("s = 'b'").orderBy("i").collect()
    assert [(x.i, pytest.approx(x.equity)) for x in got] == want
    assert backtest.backtest_summary(backtest.backtest(df, ["s"], ["i"], cfg), ["s"], cfg).where("s = 'a'").first().total_pnl == pytest.approx(bank - cfg.bankroll)


def fold(plays, cfg):
    """index, bankroll and peak of each trade of (index, y, p)."""
    bank = peak = cfg.bankroll
    out = []
    for i, y, p in plays:
        odds = 1 - cfg.fee
        stake = min(bank * max(0, min((p * odds - (1 - p)) / odds, cfg.kelly_cap)) if cfg.kelly else cfg.max_position, cfg.max_position, bank / 2)
        if p >= cfg.threshold and stake >= 1 and bank >= 10:
            bank += stake * odds if y == 1 else -stake
            peak = max(peak, bank)
            out.append((i, bank, peak))
    return out


@pytest.mark.parametrize("cfg", [BacktestConfig(kelly=k, bankroll=b, max_position=m, kelly_cap=c) for k, b, m, c in [(False, 100.0, 10.0, 0.25), (False, 31.5, 10.0, 0.25), (True, 60.0, 10.0, 0.25), (True, 300.0, 25.0, 0.9), (False, 9.0, 10.0, 0.25), (False, 100.0, 0.5, 0.25)]])
def test_backtest_in_chunks_equals_the_fold(spark, cfg):
    """Keys of one row to many chunks, among them ones that go bust, and repeated rows."""
    rng = __import__("random").Random(7)
    plays = {k: [(i, float(rng.random() < share), round(rng.uniform(0.5, 0.8), 6)) for i in range(n)] for k, n, share in [("a", 700, 0.5), ("b", 1, 1.0), ("c", 33, 0.6), ("d", 400, 0.3), ("e", 500, 0.55), ("f", 16, 0.5)]}
    df = spark.createDataFrame([(k, "x", *r) for k, rows in plays.items() for r in rows], "k string, l string, i long, y double, p double").repartition(5)
    got = backtest.backtest(df, ["k", "l"], ["i"], cfg, chunk=16).collect()
    for k, rows in plays.items():
        own = sorted((x for x in got if x.k == k), key=lambda x: x.seq)
        want = fold(rows, cfg)
        assert [x.i for x in own] == [x[0] for x in want] and [x.seq for x in own] == list(range(1, len(want) + 1))
        assert [x.equity for x in own] == pytest.approx([x[1] for x in want]) and [x.peak for x in own] == pytest.approx([x[2] for x in want])
        assert [x.drawdown for x in own] == pytest.approx([x[2] - x[1] for x in want], abs=1e-6)
    assert backtest.backtest(df.limit(0), ["k", "l"], ["i"], cfg).count() == 0


def test_backtest_chunks_are_spread_over_tasks(spark):
    """One key of all rows: no task has more than twice its share."""
    df = spark.range(40_000).select(F.lit("a").alias("k"), "id", (F.xxhash64("id") % 2 == 0).cast("double").alias("y"), F.lit(0.6).alias("p")).repartition(3)
    chunks = backtest.chunked(df, ["k"], ["id"], BacktestConfig(), 512)
    per_task = chunks.groupBy(F.shiftright("chunk", 32)).agg(F.sum(F.size("rows")).alias("n")).collect()
    assert len(per_task) == 4 and max(x.n for x in per_task) <= 2 * 40_000 / 4
    order = [x.id for c in chunks.orderBy("chunk").collect() for x in c.rows]
    assert order == sorted(order) and len(order) == 40_000


@pytest.mark.parametrize("kelly", [False, True])
def test_maps_of_chunks_equal_replays(kelly):
    rng = np.random.default_rng(3)
    for _ in range(25):
        n, cfg = int(rng.integers(1, 300)), BacktestConfig(kelly=kelly, max_position=float(rng.choice([0.5, 2, 10, 50])), kelly_cap=float(rng.choice([0.05, 0.25, 0.9])))
        y, p = (rng.random(n) < 0.5).astype(float), rng.uniform(0.45, 0.99, n)
        total, high, trades, top = backtest.summary(y, p, cfg)
        after = lambda b: backtest.replay(y, p, b, cfg)[3]  # noqa: B023, E731
        equity = after(max(high, 10) + 1.5)
        assert len(equity) == trades and (not trades or (equity[-1] == pytest.approx(max(high, 10) + 1.5 + total) and max(equity.max() - max(high, 10) - 1.5, 0) == pytest.approx(top)))
        if high > backtest.BUST:
            left, a, c = backtest.pieces(y, p, high, cfg)
            for b in rng.uniform(10, high, 60):
                at = np.searchsorted(left, b, "right") - 1
                assert a[at] * b + c[at] == pytest.approx((after(b) if len(after(b)) else [b])[-1])


def test_fills(spark):
    raw = spark.createDataFrame([("1704067200", "A", "0", "2000000", "1000000", "h1"), ("1704067200", "0", "A", "1", "1", "h2"), ("x", "B", "1", "0", "5", "h3"), ("1", None, "0", "1", "1", "h4"), ("1", "A", "0", "zz", "1", "h5")], "timestamp string, makerAssetId string, takerAssetId string, makerAmountFilled string, takerAmountFilled string, transactionHash string")
    lookup = convert.token_lookup(spark.createDataFrame([("1", "A", "B", 1), ("2", "A", "", 2), (None, "C", "D", 3)], "id string, token1 string, token2 string, seq long"), "seq")
    got = {x.tx_hash: (x.market_id, x.side, x.price, x.direction) for x in convert.convert_fills(raw, lookup).collect()}
    assert got == {"h1": (2, "token1", 0.5, "BUY"), "h3": (1, "token2", None, "SELL")}
    assert tuple(convert.fill_counts(raw, lookup).first()) == (2, 1, 2)


def test_random_strategy_does_not_depend_on_partitions(spark):
    df = spark.range(50).select(F.col("id").alias("market_id"), F.lit(T0).cast("timestamp_ntz").alias("bucket_time"), F.lit(1).alias("win"))
    first, second = ({x.market_id: x.p for x in strategies.random(d).collect()} for d in (df, df.repartition(7)))
    assert first == second and len(set(first.values())) == 50


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    lines = [f'{{"timestamp": {1704067200 + 40 * i}, "price": "0.{i % 9 + 1}", "size": "10", "outcome": "YES", "token_id": "t", "hash": "h{i}"}}' for i in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*lines, lines[3], '{"price": 1}', "junk"]))
    live.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    store = spark.read.parquet(str(tmp_path / "out"))
    assert store.count() == 60
    assert live.prune(store, 0, datetime(2024, 1, 1, 0, 20)).count() == 30
    assert live.newer(live.parse_trades(spark.createDataFrame([(x,) for x in lines], "value string")), store.where("timestamp <= 1704067300")).count() == 57
