"""DuckDB SQL with the results of ``queries``, put together from shared common table expressions."""

from __future__ import annotations

from tidemark.config import BacktestConfig
from tidemark.operators.strategies import STRATEGIES

CFG = BacktestConfig()
LAGS, WINDOWS = (1, 2, 3, 6, 12), (6, 12, 24, 48)
LAGGED = ("mean_price", "total_usd", "trade_count", "momentum", "yes_ratio")
PRICES = ("open_price", "close_price", "high_price", "low_price", "mean_price", "vwap", "momentum")
STATS = ("trade_count", "total_usd", "total_tokens", "open_price", "close_price", "high_price", "low_price", "mean_price", "yes_ratio", "whale_count", "whale_usd", "buy_ratio", "vwap", "momentum")
INTS = {"trade_count", "whale_count"}


def r(*columns: str) -> str:
    return ", ".join(c if c in INTS else f"round({c}::DOUBLE, 6) AS {c}" for c in columns)


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN CASE WHEN ({n}) > 0 THEN 'inf'::DOUBLE WHEN ({n}) < 0 THEN '-inf'::DOUBLE END ELSE ({n})::DOUBLE / ({d}) END"


TRADES = """raw AS (SELECT ts AS "timestamp", user_id AS market_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'token1' WHEN event_type IN ('view', 'signup') THEN 'token2' ELSE 'other' END AS side,
  (CAST(json_extract_string(props, '$.k') AS INTEGER) + 0.5::DOUBLE) / 100.0::DOUBLE AS price, value * 10.0::DOUBLE AS usd_amount FROM events),
trades AS (SELECT "timestamp", market_id, CASE side WHEN 'token1' THEN 1 WHEN 'token2' THEN 0 ELSE -1 END AS is_yes, price, usd_amount, usd_amount / price AS token_amount, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS is_buy, event_id FROM raw)"""
BUCKETS = """sums AS (SELECT market_id, time_bucket(INTERVAL '60 minutes', "timestamp") AS bucket_time, count(*) AS trade_count, sum(usd_amount) AS total_usd, sum(token_amount) AS total_tokens,
  arg_min(price, "timestamp") AS open_price, arg_max(price, "timestamp") AS close_price, max(price) AS high_price, min(price) AS low_price, avg(price) AS mean_price, avg(is_yes::DOUBLE) AS yes_ratio,
  count(*) FILTER (usd_amount > 1000) AS whale_count, coalesce(sum(usd_amount) FILTER (usd_amount > 1000), 0.0::DOUBLE) AS whale_usd, sum(price * usd_amount) AS weighted, avg(is_buy::DOUBLE) AS buy_ratio FROM trades GROUP BY ALL),
buckets AS (SELECT * EXCLUDE (weighted), CASE WHEN total_usd <> 0 THEN weighted / total_usd END AS vwap, close_price - open_price AS momentum FROM sums)"""
FILLED = f"""grid AS (SELECT market_id, unnest(generate_series(min(bucket_time), max(bucket_time), INTERVAL '60 minutes')) AS bucket_time FROM buckets GROUP BY market_id),
filled AS (SELECT g.market_id, g.bucket_time, {", ".join(f"coalesce(b.{c}, 0) AS {c}" for c in ("trade_count", "whale_count"))}, {", ".join(f"coalesce(b.{c}, 0.0::DOUBLE) AS {c}" for c in ("total_usd", "total_tokens", "whale_usd"))},
  {", ".join(f"last_value(b.{c} IGNORE NULLS) OVER w AS {c}" for c in PRICES)}, {", ".join(f"coalesce(b.{c}, 0.5::DOUBLE) AS {c}" for c in ("yes_ratio", "buy_ratio"))}, b.trade_count IS NULL AS is_empty_bucket,
  g.bucket_time >= TIMESTAMP '2025-10-01' AND g.bucket_time < TIMESTAMP '2026-02-01' AS in_gap
  FROM grid g LEFT JOIN buckets b USING (market_id, bucket_time) WINDOW w AS (PARTITION BY g.market_id ORDER BY g.bucket_time ROWS UNBOUNDED PRECEDING))"""


def long_gap(mode: str) -> str:
    length = "n" if mode == "run" else "greatest(at_, n - at_ + 1)"
    return f"""islands AS (SELECT *, sum(CASE WHEN is_empty_bucket THEN 0 ELSE 1 END) OVER (PARTITION BY market_id ORDER BY bucket_time ROWS UNBOUNDED PRECEDING) AS island FROM filled),
placed AS (SELECT *, row_number() OVER (PARTITION BY market_id, island, is_empty_bucket ORDER BY bucket_time) AS at_, count(*) OVER (PARTITION BY market_id, island, is_empty_bucket) AS n FROM islands),
flagged AS (SELECT * EXCLUDE (island, at_, n), is_empty_bucket AND {length} > 48 AS in_long_gap, in_gap OR (is_empty_bucket AND {length} > 48) AS exclude_from_training FROM placed)"""


W = "WINDOW m AS (PARTITION BY market_id ORDER BY bucket_time)"
LAG = f"""lagged AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER m AS {c}_lag{k}" for c in LAGGED for k in LAGS)} FROM flagged {W})"""
RETURNS = f"""returned AS (SELECT *, {", ".join(f"mean_price - mean_price_lag{k} AS price_change_lag{k}, {ratio(f'mean_price - mean_price_lag{k}', f'mean_price_lag{k}')} AS price_return_lag{k}" for k in LAGS)} FROM lagged)"""


def _roll(f: str, c: str, n: int, name: str) -> str:
    rows = f"(PARTITION BY market_id ORDER BY bucket_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {rows} = {n} THEN {f}({c}) OVER {rows} END AS {name}{n}"


ROLLED = [_roll(f, c, n, name) for n in WINDOWS for f, c, name in (("avg", "mean_price", "price_ma"), ("stddev_samp", "mean_price", "price_std"), ("sum", "total_usd", "volume_sum"), ("avg", "trade_count", "trade_count_ma"), ("avg", "momentum", "momentum_ma"))]
ROLL = f"""rolled AS (SELECT *, {", ".join(ROLLED)} FROM returned),
versus AS (SELECT *, {", ".join(f"{ratio(f'mean_price - price_ma{n}', f'price_ma{n}')} AS price_vs_ma{n}" for n in WINDOWS)} FROM rolled)"""
MARKETS = """markets AS (SELECT c_custkey AS market_id, c_name AS question, (((c_custkey % 100) + 0.5::DOUBLE) / 100.0::DOUBLE)::FLOAT AS yes_price, (1.0::DOUBLE - ((c_custkey % 100) + 0.5::DOUBLE) / 100.0::DOUBLE)::FLOAT AS no_price,
  (abs(c_acctbal) * 10.0::DOUBLE)::FLOAT AS volume, (CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE abs(c_acctbal) END)::FLOAT AS liquidity, TIMESTAMP '2024-01-20' + to_days((c_custkey % 60)::INTEGER) AS close_time FROM customer)"""
P = "greatest(least(yes_price::DOUBLE, 1 - 1e-9::DOUBLE), 1e-9::DOUBLE)"
JOINED = f"""joined AS (SELECT v.*, yes_price, no_price, volume, liquidity, close_time, abs(yes_price::DOUBLE - no_price::DOUBLE) AS market_spread,
  -({P} * log2({P}) + (1 - {P}) * log2(1 - {P})) AS market_entropy, (epoch(close_time) - epoch(bucket_time)) / 86400.0::DOUBLE AS days_to_close FROM versus v LEFT JOIN markets USING (market_id)),
crossed AS (SELECT *, mean_price - yes_price::DOUBLE AS entry_vs_market, {ratio("total_usd", "liquidity::DOUBLE")} AS trade_size_vs_liquidity, {ratio("total_usd", "volume::DOUBLE")} AS volume_concentration,
  CASE WHEN trade_count = 0 THEN 0.0::DOUBLE ELSE whale_count::DOUBLE / trade_count END AS whale_ratio, (CASE WHEN trade_count = 0 THEN 0.0::DOUBLE ELSE whale_count::DOUBLE / trade_count END) * momentum AS whale_momentum,
  {ratio("momentum", "days_to_close + 1.0::DOUBLE")} AS momentum_per_day FROM joined),
featured AS (SELECT *, hour(bucket_time) AS hour, isodow(bucket_time) AS day_of_week, {", ".join(f"{f}(2 * pi() * {c}(bucket_time) / {n}.0::DOUBLE) AS {name}_{f}" for c, n, name in (("hour", 24, "hour"), ("isodow", 7, "dow")) for f in ("sin", "cos"))},
  CASE WHEN isodow(bucket_time) >= 5 THEN 1 ELSE 0 END AS is_weekend FROM crossed)"""


def label(source: str) -> str:
    return f"""ahead AS (SELECT *, lead(mean_price, 6) OVER m AS future_price FROM {source} {W}),
labeled AS (SELECT *, CASE WHEN NOT (exclude_from_training OR is_empty_bucket) THEN {ratio("future_price - mean_price", "mean_price")} END AS future_return,
  CASE WHEN exclude_from_training OR is_empty_bucket THEN NULL WHEN yes_ratio > 0.5::DOUBLE THEN CASE WHEN future_price > mean_price + 0.001::DOUBLE THEN 1 WHEN future_price < mean_price - 0.001::DOUBLE THEN 0 END
  ELSE CASE WHEN future_price < mean_price - 0.001::DOUBLE THEN 1 WHEN future_price > mean_price + 0.001::DOUBLE THEN 0 END END AS win FROM ahead)"""


SPLIT = """ranked AS (SELECT *, row_number() OVER (ORDER BY bucket_time, market_id) - 1 AS position, count(*) OVER () AS total FROM labeled WHERE win IS NOT NULL),
split AS (SELECT *, CASE WHEN position < floor(total * 0.7::DOUBLE) - 6 THEN 'train' WHEN position >= floor(total * 0.7::DOUBLE) + 12 AND position < floor(total * 0.7::DOUBLE) + 12 + floor(total * 0.15::DOUBLE) - 6 THEN 'validation'
  WHEN position >= floor(total * 0.7::DOUBLE) + 12 + floor(total * 0.15::DOUBLE) - 6 + 12 THEN 'test' END AS split FROM ranked)"""
BASE = [TRADES, BUCKETS, FILLED]
FEATURES = [*BASE, long_gap("edge"), LAG, RETURNS, ROLL, MARKETS, JOINED]
DATASET = [*FEATURES, label("featured")]
LABELS = [*BASE, long_gap("edge"), label("flagged")]

D = "CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END"
CHANGE = D.format(x="(CASE WHEN yes_ratio > 0.5::DOUBLE THEN price_change_lag3 ELSE -price_change_lag3 END)")
DEV = D.format(x="price_vs_ma24")
SPIKE = "(CASE WHEN volume_sum24 / 24.0::DOUBLE > 0 THEN total_usd / (volume_sum24 / 24.0::DOUBLE) ELSE 1.0::DOUBLE END)"
URGENCY = "least(greatest(1.0::DOUBLE - days / 14.0::DOUBLE, 0.0), 1.0)"
DIRECTION = "(least(greatest(CASE WHEN yes_ratio > 0.5::DOUBLE THEN mean_price - 0.5::DOUBLE ELSE 0.5::DOUBLE - mean_price END, 0.0), 0.5) / 0.5::DOUBLE)"
#: score, condition, and whether the target is turned
RULES = {
    "baseline": ("0.95::DOUBLE", "true", False),
    "random": ("('0x' || substr(md5(market_id::VARCHAR || '|' || bucket_time::VARCHAR || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE", "true", False),
    "momentum": (f"1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(({CHANGE}) * 20.0::DOUBLE, 30.0), -30.0)))", f"abs({CHANGE}) > 0.005::DOUBLE", False),
    "reversion": (f"0.5::DOUBLE + 0.5::DOUBLE * least(abs({DEV}) / 0.2::DOUBLE, 1.0)", f"(yes_ratio > 0.5::DOUBLE AND ({DEV}) > 0.04::DOUBLE) OR (NOT yes_ratio > 0.5::DOUBLE AND ({DEV}) < -0.04::DOUBLE)", True),
    "volume": (f"0.5::DOUBLE + 0.5::DOUBLE * least(greatest(({SPIKE} - 1.0::DOUBLE) / 8.0::DOUBLE, 0.0), 1.0)", f"{SPIKE} >= 3", False),
    "closing": (f"least(greatest(0.5::DOUBLE + {URGENCY} * {DIRECTION} * 0.45::DOUBLE, 0.0), 1.0)", f"days >= 0 AND days < 14 AND {DIRECTION} > 0.15::DOUBLE AND {URGENCY} > 0.05::DOUBLE", False),
    "contrarian": ("0.5::DOUBLE + 0.5::DOUBLE * least(abs(yes_ratio - 0.5::DOUBLE) * 2.0::DOUBLE, abs(mean_price - 0.5::DOUBLE) * 2.0::DOUBLE)", "(yes_ratio > 0.65::DOUBLE AND mean_price > 0.65::DOUBLE) OR (yes_ratio < 1 - 0.65::DOUBLE AND mean_price < 1 - 0.65::DOUBLE)", True),
}


def played(name: str, source: str) -> str:
    score, fires, turned = RULES[name]
    return f"SELECT '{name}' AS strategy, market_id, bucket_time, {'1.0::DOUBLE - win' if turned else 'win::DOUBLE'} AS y, CASE WHEN {fires} THEN {score} ELSE 0.5::DOUBLE END AS p, coalesce({fires}, false) AS fires FROM {source}"


def long(source: str = "rows_") -> str:
    return f"rows_ AS (SELECT *, coalesce(days_to_close, 999.0::DOUBLE) AS days FROM labeled WHERE win IS NOT NULL), long AS ({' UNION ALL '.join(played(n, source) for n in STRATEGIES)})"


LONG = [*DATASET, long()]
COUNTS = "count(*) AS n, count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y <> 1) AS fp, count(*) FILTER (NOT p >= {t} AND y = 1) AS fn, count(*) FILTER (NOT p >= {t} AND y <> 1) AS tn".format(t=f"{CFG.threshold}::DOUBLE")
AUC = """scores AS (SELECT strategy, round(p, 12) AS p, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY ALL), credit AS (SELECT strategy, pos, neg, pos * (sum(neg) OVER (PARTITION BY strategy ORDER BY p) - neg + 0.5::DOUBLE * neg) AS c FROM scores),
auc AS (SELECT strategy, sum(c) / nullif(sum(pos) * sum(neg), 0) AS auc FROM credit GROUP BY strategy)"""


def folded(source: str, key: str, threshold: str) -> str:
    """The bankroll as a recursion over each key's rows in order."""
    size = f"least({CFG.max_position}::DOUBLE, bankroll * 0.5::DOUBLE)"
    plays = f"{size} >= 1 AND bankroll >= 10"
    gain = f"CASE WHEN q.y = 1 THEN {size} * (1.0::DOUBLE - {CFG.fee}::DOUBLE) ELSE -{size} END"
    return f"""queue AS (SELECT {key} AS k, *, row_number() OVER (PARTITION BY {key} ORDER BY bucket_time, market_id) AS i FROM {source} WHERE p >= {threshold}),
fold AS (SELECT k, 0::BIGINT AS i, {CFG.bankroll}::DOUBLE AS bankroll, {CFG.bankroll}::DOUBLE AS peak, 0::BIGINT AS seq, NULL::DOUBLE AS stake, NULL::DOUBLE AS pnl, false AS traded FROM (SELECT DISTINCT k FROM queue)
  UNION ALL SELECT f.k, q.i, CASE WHEN {plays} THEN bankroll + {gain} ELSE bankroll END, CASE WHEN {plays} THEN greatest(peak, bankroll + {gain}) ELSE peak END, CASE WHEN {plays} THEN seq + 1 ELSE seq END,
  CASE WHEN {plays} THEN {size} END, CASE WHEN {plays} THEN {gain} END, {plays} FROM fold f JOIN queue q ON q.k = f.k AND q.i = f.i + 1),
won AS (SELECT f.*, q.* EXCLUDE (k, i), bankroll AS equity, peak - bankroll AS drawdown FROM fold f JOIN queue q USING (k, i) WHERE traded)"""


SUMMARY = f"""count(*) AS trades, count(*) FILTER (pnl > 0) AS winning, count(*) FILTER (pnl <= 0) AS losing, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS trade_win_rate, round(sum(pnl), 6) AS total_pnl,
  round(sum(pnl) / {CFG.bankroll}::DOUBLE, 6) AS roi, round(max(drawdown), 6) AS max_drawdown, round(max(drawdown) / max(peak), 6) AS max_drawdown_pct, round(CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) * sqrt(288.0::DOUBLE) ELSE 0 END, 6) AS sharpe"""


def q(parts: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"


def r_inf(c: str) -> str:
    return f"CASE WHEN NOT isinf({c}) THEN round({c}, 6) END AS {c}, CASE WHEN {c} = 'inf'::DOUBLE THEN 'inf' WHEN {c} = '-inf'::DOUBLE THEN '-inf' END AS {c}_inf"


FILLS = """lookup AS (SELECT 'Y' || p_partkey AS token, p_partkey AS market_id, 'token1' AS side FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'N' || p_partkey, p_partkey, 'token2' FROM part WHERE p_partkey % 10 <> 0),
fills AS (SELECT l_shipdate AS "timestamp", CASE WHEN l_linestatus = 'F' THEN '0' WHEN l_returnflag = 'R' THEN 'N' || l_partkey ELSE 'Y' || l_partkey END AS maker,
  CASE WHEN l_linenumber % 2 = 0 THEN '1' WHEN l_linestatus <> 'F' THEN '0' ELSE 'Y' || l_partkey END AS taker, (l_quantity * 1e6::DOUBLE)::BIGINT / 1e6::DOUBLE AS tokens, round(l_quantity * l_discount * 1e6::DOUBLE)::BIGINT / 1e6::DOUBLE AS usd, l_orderkey || '-' || l_linenumber AS tx_hash FROM lineitem),
matched AS (SELECT f.*, market_id, side FROM fills f LEFT JOIN lookup ON maker = token)"""
RECORDS = """records AS (SELECT *, floor(epoch("timestamp"))::BIGINT AS s, usd_amount / price AS tokens FROM raw, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR event_id % 4 = 0),
parsed AS (SELECT market_id::VARCHAR AS token_id, s AS "timestamp", round(price, 6) AS price, round(price * tokens, 6) AS usd_amount, round(tokens, 6) AS token_amount, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS is_yes, 'h' || event_id AS tx_hash FROM records
  WHERE (event_id % 3 <> 2 OR event_id % 5 > 0) AND tokens <> 0)"""
ALL_STATS = f"market_id, bucket_time, {r(*STATS)}"
TEST = ["start_ AS (SELECT min(bucket_time) AS t FROM split WHERE split = 'test')", "rows_ AS (SELECT *, coalesce(days_to_close, 999.0::DOUBLE) AS days FROM split, start_ WHERE bucket_time >= t)", f"long AS ({' UNION ALL '.join(played(n, 'rows_') for n in STRATEGIES)})",
        "valid AS (SELECT * REPLACE (least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p) FROM long)"]
FEATURE_NAMES = [*STATS[:13], "momentum", *(f"{c}_lag{k}" for c in LAGGED for k in LAGS), *(f"price_{c}_lag{k}" for k in LAGS for c in ("change", "return")), *(f"{c}{n}" for n in WINDOWS for c in ("price_ma", "price_std", "volume_sum", "trade_count_ma", "momentum_ma", "price_vs_ma")),
                 "yes_price", "no_price", "volume", "liquidity", "market_spread", "market_entropy", "days_to_close", "entry_vs_market", "trade_size_vs_liquidity", "volume_concentration", "whale_ratio", "whale_momentum", "momentum_per_day", "hour", "day_of_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend"]

ORACLES = {
    "normalize_trades": q([TRADES], 'SELECT "timestamp", market_id, is_yes, round(price, 6) AS price, round(usd_amount, 6) AS usd_amount, round(token_amount, 6) AS token_amount, is_buy, event_id FROM trades'),
    "normalize_markets": q([MARKETS], f"SELECT market_id, question, {r('yes_price', 'no_price', 'volume', 'liquidity')}, close_time FROM markets"),
    "fills_etl": q([FILLS], """SELECT "timestamp", market_id, side, round(CASE WHEN tokens > 0 THEN usd / tokens END, 6) AS price, round(usd, 6) AS usd_amount, round(tokens, 6) AS token_amount, CASE WHEN taker = '0' THEN 'BUY' ELSE 'SELL' END AS direction, tx_hash FROM matched WHERE maker <> '0' AND market_id IS NOT NULL"""),
    "fills_counts": q([FILLS], "SELECT count(*) FILTER (maker <> '0' AND market_id IS NOT NULL) AS kept, count(*) FILTER (maker = '0') AS settlement, count(*) FILTER (maker <> '0' AND market_id IS NULL) AS unmatched FROM matched"),
    "token_lookup_join": q([FILLS], "SELECT side, count(*) AS fills, count(DISTINCT market_id) AS markets FROM matched WHERE maker <> '0' AND market_id IS NOT NULL GROUP BY side"),
    "bucket_ohlcv": q([TRADES, BUCKETS], f"SELECT {ALL_STATS} FROM buckets"),
    "stream_buckets": q([TRADES, BUCKETS], f"SELECT {ALL_STATS} FROM buckets"),
    "bucket_whales": q([TRADES, BUCKETS], "SELECT market_id, bucket_time, trade_count, whale_count, round(whale_usd, 6) AS whale_usd FROM buckets WHERE whale_count > 0"),
    "gap_fill": q(BASE, f"SELECT {ALL_STATS}, is_empty_bucket, in_gap FROM filled"),
    "exclusions": q([*BASE, long_gap("edge")], "SELECT count(*) AS rows, count(*) FILTER (is_empty_bucket) AS empty_rows, count(*) FILTER (exclude_from_training) AS excluded_rows, count(DISTINCT market_id) AS markets FROM flagged"),
    "lag_features": q([*BASE, long_gap("edge"), LAG], f"SELECT market_id, bucket_time, {', '.join(f'{c}_lag{k}' if c == 'trade_count' else f'round({c}_lag{k}, 6) AS {c}_lag{k}' for c in LAGGED for k in LAGS)} FROM lagged"),
    "price_returns": q([*BASE, long_gap("edge"), LAG, RETURNS], f"SELECT market_id, bucket_time, {r(*(f'price_{c}_lag{k}' for k in LAGS for c in ('change', 'return')))} FROM returned"),
    "market_features": q(FEATURES, f"SELECT market_id, bucket_time, {r('yes_price', 'no_price', 'volume', 'liquidity', 'market_spread', 'market_entropy', 'days_to_close')} FROM featured"),
    "cross_features": q(FEATURES, f"SELECT market_id, bucket_time, {r('entry_vs_market', 'whale_ratio', 'whale_momentum')}, {', '.join(map(r_inf, ('trade_size_vs_liquidity', 'volume_concentration', 'momentum_per_day')))} FROM featured"),
    "time_features": q(FEATURES, f"SELECT market_id, bucket_time, hour, day_of_week, {r('hour_sin', 'hour_cos', 'dow_sin', 'dow_cos')}, is_weekend FROM featured"),
    "feature_matrix": q(FEATURES, " UNION ALL ".join(f"SELECT '{c}' AS feature, count(x) AS known, round(avg(x), 5) AS mean FROM (SELECT CASE WHEN NOT isinf({c}::DOUBLE) THEN {c}::DOUBLE END AS x FROM featured)" for c in FEATURE_NAMES)),
    "labels": q(LABELS, "SELECT market_id, bucket_time, round(future_price, 6) AS future_price, round(future_return, 6) AS future_return, win FROM labeled"),
    "label_stats": q(LABELS, "SELECT count(*) AS total, count(win) AS labeled, count(*) - count(win) AS nullified, count(*) FILTER (win = 1) AS wins, count(*) FILTER (win = 0) AS losses, round(coalesce(count(*) FILTER (win = 1) / nullif(count(win), 0)::DOUBLE, 0), 6) AS win_rate, round(avg(future_return), 6) AS mean_return, round(stddev_samp(future_return), 6) AS std_return FROM labeled"),
    "walk_forward_split": q([*LABELS, SPLIT], "SELECT market_id, bucket_time, position, split FROM split"),
    "split_summary": q([*LABELS, SPLIT], "SELECT split, count(*) AS rows, min(bucket_time) AS first_time, max(bucket_time) AS last_time, round(avg(win), 6) AS win_rate FROM split WHERE split IS NOT NULL GROUP BY split"),
    "holdout_split": q(LABELS, "SELECT market_id, bucket_time, CASE WHEN bucket_time >= top - INTERVAL '7 days' THEN 'test' WHEN bucket_time < top - INTERVAL '7 days' - INTERVAL '60 minutes' THEN 'train' END AS split FROM (SELECT *, max(bucket_time) OVER () AS top FROM labeled WHERE win IS NOT NULL)"),
    "time_chunks": q([TRADES, BUCKETS], """SELECT chunk_id, is_context, count(*) AS rows, min(bucket_time) AS first_time, max(bucket_time) AS last_time FROM (SELECT bucket_time, floor(s / 604800)::BIGINT AS chunk_id, false AS is_context FROM (SELECT *, epoch(bucket_time) - epoch(min(bucket_time) OVER ()) AS s FROM buckets)
      UNION ALL SELECT bucket_time, floor(s / 604800)::BIGINT + 1, true FROM (SELECT *, epoch(bucket_time) - epoch(min(bucket_time) OVER ()) AS s FROM buckets) WHERE 604800 * (floor(s / 604800) + 1) - s <= 216000) GROUP BY ALL"""),
    "strategy_coverage": q(LONG, "SELECT strategy, round(avg(fires::INTEGER), 6) AS coverage FROM long GROUP BY strategy"),
    "metrics_confusion": q(LONG, f"SELECT *, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM (SELECT strategy, {COUNTS} FROM long GROUP BY strategy)"),
    "metrics_logloss_brier": q(LONG, "SELECT strategy, round(avg(-ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM long GROUP BY strategy"),
    "metrics_auc": q([*LONG, AUC.format(source="long")], "SELECT strategy, round(auc, 6) AS auc FROM auc"),
    "calibration": q(LONG, f"SELECT *, round((bin + 0.5::DOUBLE) / 10, 6) AS center FROM (SELECT strategy, CASE {' '.join(f'WHEN p >= {i * 0.1!r}::DOUBLE AND p < {(i + 1) * 0.1 if i < 9 else 1.0!r}::DOUBLE THEN {i}' for i in range(10))} END AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM long GROUP BY ALL) WHERE bin IS NOT NULL"),
    "backtest_equity": q([*LONG, folded("long", "strategy", f"{CFG.threshold}::DOUBLE")], f"SELECT strategy, market_id, bucket_time, seq, {r('stake', 'pnl', 'equity', 'peak', 'drawdown')} FROM won", True),
    "backtest_summary": q([*LONG, folded("long", "strategy", f"{CFG.threshold}::DOUBLE")], f"SELECT strategy, {SUMMARY} FROM won GROUP BY strategy", True),
    "threshold_sweep": q([*LONG, "each AS (SELECT * FROM long, (SELECT unnest([0.5::DOUBLE, 0.55::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]) AS threshold))", folded("each", "strategy || threshold::VARCHAR", "threshold")], f"SELECT strategy, threshold, {SUMMARY} FROM won GROUP BY strategy, threshold", True),
    "strategy_benchmark": q([*DATASET, SPLIT, *TEST, AUC.format(source="valid"), folded("valid", "strategy", f"{CFG.threshold}::DOUBLE")], """SELECT strategy, coverage, 'ok' AS status, n, round(auc, 6) AS auc, brier, trades, total_pnl FROM (SELECT strategy, round(avg(fires::INTEGER), 6) AS coverage FROM long GROUP BY strategy)
      JOIN (SELECT strategy, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM valid GROUP BY strategy) USING (strategy) JOIN auc USING (strategy) LEFT JOIN (SELECT strategy, count(*) AS trades, round(sum(pnl), 6) AS total_pnl FROM won GROUP BY strategy) USING (strategy)""", True),
    "json_trade_parse": q([TRADES, RECORDS], "SELECT * FROM parsed"),
    "dedup_trades": q([TRADES, RECORDS], "SELECT DISTINCT * FROM parsed"),
    "retention": q([TRADES, RECORDS], 'SELECT token_id, count(DISTINCT tx_hash) AS trades, max("timestamp") AS latest FROM parsed WHERE "timestamp" >= (SELECT max("timestamp") FROM parsed) - 604800 GROUP BY token_id'),
    "run_history": q([TRADES], """SELECT type, ts, trades, test_auc FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC) AS n FROM (SELECT CASE WHEN day(d) % 2 = 0 THEN 'model' ELSE 'bench' END AS type, d::VARCHAR AS ts, trades, test_auc FROM (SELECT "timestamp"::DATE AS d, count(*) AS trades, round(avg(price), 6) AS test_auc FROM raw GROUP BY d))) WHERE n <= 5"""),
    "strategy_roi": q([TRADES], """SELECT "timestamp"::DATE::VARCHAR AS ts, round(avg(price) FILTER (side = 'token1'), 6) AS token1, round(avg(price) FILTER (side = 'token2'), 6) AS token2, round(avg(price) FILTER (side = 'other'), 6) AS other FROM raw GROUP BY 1"""),
}
SUMMARY_OF_GAPS = """summary AS (SELECT market_id, min(bucket_time) AS first_bucket, max(bucket_time) AS last_bucket, count(*) AS actual_buckets, (floor((epoch(max(bucket_time)) - epoch(min(bucket_time))) / 3600) + 1)::BIGINT AS expected_buckets FROM buckets GROUP BY market_id)"""
ORACLES["gap_summary"] = q([TRADES, BUCKETS, SUMMARY_OF_GAPS], "SELECT *, expected_buckets - actual_buckets AS missing_buckets, round((expected_buckets - actual_buckets) / expected_buckets::DOUBLE, 6) AS missing_ratio, first_bucket < TIMESTAMP '2026-02-01' AND last_bucket > TIMESTAMP '2025-10-01' AS overlaps_gap FROM summary")
ORACLES["gap_rollup"] = q([TRADES, BUCKETS, SUMMARY_OF_GAPS], "SELECT count(*) AS markets, round(avg((expected_buckets - actual_buckets) / expected_buckets::DOUBLE), 6) AS mean_missing_ratio, count(*) FILTER ((expected_buckets - actual_buckets) / expected_buckets::DOUBLE > 0.5) AS sparse_markets FROM summary")
ORACLES |= {f"long_gap_{k}": q([*BASE, long_gap(k)], "SELECT market_id, bucket_time, is_empty_bucket, in_long_gap FROM flagged") for k in ("edge", "run")}
ORACLES |= {f"strategy_{n}": q(LONG, f"SELECT market_id, bucket_time, y, round(p, 6) AS p, fires FROM long WHERE strategy = '{n}'") for n in STRATEGIES}
_ROLLED = {"rolling_mean": ("price_ma", "trade_count_ma", "momentum_ma"), "rolling_std": ("price_std",), "rolling_sum": ("volume_sum",), "price_vs_ma": ("price_vs_ma",)}
ORACLES |= {k: q([*BASE, long_gap("edge"), LAG, RETURNS, ROLL], f"SELECT market_id, bucket_time, {', '.join(f'round({c}{n} * (1.0::DOUBLE + 1e-12::DOUBLE), 6) AS {c}{n}' for n in WINDOWS for c in names)} FROM versus") for k, names in _ROLLED.items()}
_LOW = [c for c in FEATURE_NAMES if not c.endswith(("_lag2", "_lag12", "24", "48"))]
ORACLES["low_memory_features"] = q(FEATURES, " UNION ALL ".join(f"SELECT '{c}' AS feature, count(x) AS known, round(avg(x), 5) AS mean FROM (SELECT CASE WHEN NOT isinf({c}::DOUBLE) THEN {c}::DOUBLE END AS x FROM featured)" for c in _LOW))
ORACLES["aligned_features"] = q([TRADES, BUCKETS], "SELECT count(*) AS rows, round(avg(mean_price), 5) AS mean_price, count(*) AS absent, round(avg(trade_count), 5) AS trade_count FROM buckets")
ORACLES["time_range"] = q([TRADES, BUCKETS], "SELECT market_id, bucket_time, trade_count, round(mean_price, 6) AS mean_price FROM buckets WHERE bucket_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
ORACLES["lookback"] = q([TRADES], """SELECT market_id, count(*) AS trades, round(sum(usd_amount), 6) AS usd FROM trades WHERE "timestamp" >= (SELECT max("timestamp") FROM trades) - INTERVAL '3600 minutes' GROUP BY market_id""")
ORACLES["csv_round_trip"] = q([TRADES], 'SELECT "timestamp", market_id, is_yes, round(price, 6) AS price, round(usd_amount, 6) AS usd_amount, round(token_amount, 6) AS token_amount, is_buy FROM trades')
ORACLES["stage_sink"] = ORACLES["bucket_ohlcv"]
ORACLES["convert_markets"] = """SELECT c_custkey::INTEGER::BIGINT AS market_id, c_name AS question, '' AS token1, CASE WHEN c_custkey % 7 <> 0 THEN round(round(c_acctbal, 2)::FLOAT::DOUBLE, 6) END AS volume,
  CASE WHEN c_custkey % 6 < 4 THEN (1705708800 + c_custkey % 60 * 86400) * 1000 + CASE c_custkey % 6 WHEN 0 THEN 500 WHEN 3 THEN -3600000 ELSE 0 END END::BIGINT AS close_ms, NULL::DOUBLE AS yes_price FROM customer"""
ORACLES["token_history"] = q([TRADES, RECORDS], """SELECT DISTINCT token_id, "timestamp", price, is_yes, tx_hash FROM parsed WHERE token_id = '7' AND "timestamp" >= 1704500000""")
ORACLES["latest_trades"] = q([TRADES, RECORDS], 'SELECT token_id, max("timestamp") AS latest FROM parsed GROUP BY token_id')
ORACLES["newer_trades"] = q([TRADES, RECORDS, 'old AS (SELECT token_id, max("timestamp") AS latest FROM parsed WHERE "timestamp" < 1705300000 GROUP BY token_id)'], 'SELECT DISTINCT token_id, "timestamp", tx_hash FROM parsed LEFT JOIN old USING (token_id) WHERE "timestamp" > coalesce(latest, 0)')
ORACLES["unseen_trades"] = q([TRADES, RECORDS], 'SELECT DISTINCT token_id, "timestamp", price, tx_hash FROM parsed WHERE NOT ("timestamp" < 1705300000 AND price >= 0.1::DOUBLE)')
_WHOLE = {"trade_count", "whale_count", "hour", "day_of_week", "is_weekend", *(f"trade_count_lag{k}" for k in LAGS)}
_INFINITE = ("trade_size_vs_liquidity", "volume_concentration", "momentum_per_day")
_LIFT = "(1.0::DOUBLE + 1e-12::DOUBLE)"
_FLOATS = [c for c in FEATURE_NAMES if c not in _WHOLE]
ORACLES["feature_chunks"] = q(FEATURES, f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {c} END AS {c}' for c in _FLOATS)}) FROM (SELECT market_id, bucket_time, {', '.join(c if c in _WHOLE else r_inf(c) if c in _INFINITE else f'round({c}::DOUBLE * {_LIFT}, 6) AS {c}' for c in FEATURE_NAMES)} FROM featured)")
_RECENT = "recent AS (SELECT * EXCLUDE (top) FROM (SELECT *, max(bucket_time) OVER (PARTITION BY market_id) AS top FROM buckets) WHERE date_diff('minute', bucket_time, top) < 3600)"
_SCORE, _FIRES, _ = RULES["momentum"]
ORACLES["latest_signal"] = q(
    [TRADES, BUCKETS, _RECENT, FILLED.replace("buckets", "recent"), "flagged AS (SELECT * FROM filled)", LAG, RETURNS, f"ranked AS (SELECT *, CASE WHEN {_FIRES} THEN {_SCORE} ELSE 0.5::DOUBLE END AS p, row_number() OVER (PARTITION BY market_id ORDER BY bucket_time DESC) AS n FROM returned)"],
    "SELECT market_id, bucket_time, round(yes_ratio, 6) AS yes_ratio, round(p, 6) AS p, CASE WHEN p >= 0.55::DOUBLE THEN CASE WHEN yes_ratio > 0.5::DOUBLE THEN 'BID YES' ELSE 'BID NO' END ELSE 'NO BID' END AS signal FROM ranked WHERE n = 1",
)
CLOSED = """fresh AS (SELECT market_id::VARCHAR AS token_id, s, price, tokens, price * tokens AS usd, CASE event_id % 3 WHEN 1 THEN 0 ELSE 1 END AS is_yes, time_bucket(INTERVAL '60 minutes', make_timestamp(s * 1000000)) AS bucket_time FROM records WHERE copy = 1 AND (event_id % 3 <> 2 OR event_id % 5 > 0) AND tokens <> 0),
closed AS (SELECT token_id, bucket_time, count(*) AS trade_count, sum(usd) AS total_usd, sum(tokens) AS total_tokens, max(price) AS high_price, min(price) AS low_price, avg(price) AS mean_price, avg(is_yes::DOUBLE) AS yes_ratio, count(*) FILTER (usd > 1000) AS whale_count, sum(price * usd) / sum(usd) AS vwap
  FROM fresh WHERE bucket_time + INTERVAL '60 minutes' <= (SELECT make_timestamp(max(s) * 1000000) FROM fresh) - INTERVAL '1 hour' GROUP BY ALL)"""
ORACLES["live_buckets"] = q([TRADES, RECORDS, CLOSED], f"SELECT token_id, bucket_time, {r('trade_count', 'total_usd', 'total_tokens', 'high_price', 'low_price', 'mean_price', 'yes_ratio', 'whale_count', 'vwap')} FROM closed")
