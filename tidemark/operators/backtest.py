"""Ordered bankroll backtest as a parallel scan over time ranges.

A trade maps the bankroll before it to the one after it. In a chunk of consecutive trades that map is, below the least bankroll
that trades at all, the identity, and from some bankroll on, as every stake is then the maximum, a sum: (sum, from where on) of two chunks
make those of both. In between it is piecewise linear. Chunks are summarised in parallel, their maps are followed in order
(a few numbers and one bit a trade, its result; pieces only with Kelly stakes, for chunks that a bankroll really enters in between), and from each chunk's first
bankroll its trades are replayed, again in parallel. No task has more than a chunk of a key's trades at a time.

Gains are added up one by one, so that bankrolls are those of the plain fold in every bit; only pieces differ from it in the last ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import BacktestConfig
from tidemark.functions.shared import partitions, stored

CHUNK = 4096
#: Below this no trade is made, ever again.
BUST, LEAST_STAKE = 10.0, 1.0
#: Pieces of a map are wider than this.
NARROW = 1e-9
#: So far above the least bankroll for maximal stakes, rounding can't matter.
SAFE = 1e-3
_OUT = ("seq", "stake", "pnl", "equity", "peak", "drawdown", "paid")
_DEAD, _HIGH, _BETWEEN, _LATER = range(4)


def slopes(p: np.ndarray, cfg: BacktestConfig) -> np.ndarray:
    """Share of the bankroll that a trade stakes, up to the maximum."""
    if not cfg.kelly:
        return np.full(len(p), 0.5)
    odds = 1.0 - cfg.fee
    return np.minimum(np.clip((p * odds - (1.0 - p)) / odds, 0.0, cfg.kelly_cap), 0.5)


def gains(y: np.ndarray, cfg: BacktestConfig) -> np.ndarray:
    """What a stake of 1 brings."""
    return np.where(y == 1, 1.0 - cfg.fee, -1.0)


def summary(y: np.ndarray, p: np.ndarray, cfg: BacktestConfig) -> tuple[float, float, int, float]:
    """Of a chunk in which every stake is the maximum: sum, least bankroll for that, number of trades, highest sum on the way."""
    s = slopes(p, cfg)
    traded = s > 0
    if not traded.any() or cfg.max_position < LEAST_STAKE:
        return 0.0, -math.inf, 0, 0.0
    sums = np.cumsum(gains(y[traded], cfg) * cfg.max_position)
    before = np.append(0.0, sums[:-1])
    return float(sums[-1]), float((np.maximum(BUST, cfg.max_position / s[traded]) - before).max()), int(traded.sum()), float(max(sums.max(), 0.0))


def pieces(y: np.ndarray, p: np.ndarray, high: float, cfg: BacktestConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left ends, slopes and intercepts of a chunk's map from BUST to ``high``."""
    left, right, a, c = np.array([BUST]), np.array([high]), np.ones(1), np.zeros(1)
    ended = []  # pieces that have gone bust
    for s, gain in zip(slopes(p, cfg).tolist(), gains(y, cfg).tolist(), strict=True):
        if s <= 0:
            continue
        enters, capped = max(BUST, LEAST_STAKE / s), cfg.max_position / s
        for bound in (enters, capped):
            cut = (bound - c) / a
            inside = np.flatnonzero((cut > left + NARROW) & (cut < right - NARROW))
            if len(inside):
                cut = cut[inside]
                left, right = np.append(left, cut), np.append(right, right[inside])
                right[inside] = cut
                a, c = np.append(a, a[inside]), np.append(c, c[inside])
        middle = a * (left + right) / 2 + c
        trades = (middle >= enters) & (cfg.max_position >= LEAST_STAKE)
        full, share = trades & (middle >= capped), trades & (middle < capped)
        c = np.where(full, c + gain * cfg.max_position, np.where(share, c * (1 + gain * s), c))
        a = np.where(share, a * (1 + gain * s), a)
        bust = a * right + c <= BUST + NARROW
        if bust.any():
            ended.append(np.stack([left[bust], a[bust], c[bust]]))
            left, right, a, c = left[~bust], right[~bust], a[~bust], c[~bust]
            if not len(left):
                break
    found = np.concatenate([*ended, np.stack([left, a, c])], 1)
    return tuple(found[:, np.argsort(found[0])])


def replay(y: np.ndarray, p: np.ndarray, bankroll: float, cfg: BacktestConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index, stake, gain and bankroll after it of each trade that is made."""
    out = []
    for i, (s, gain) in enumerate(zip(slopes(p, cfg).tolist(), gains(y, cfg).tolist(), strict=True)):
        if bankroll < BUST:
            break
        stake = min(bankroll * s, cfg.max_position)
        if s <= 0 or stake < LEAST_STAKE:
            continue
        pnl = stake * gain
        bankroll += pnl
        out.append((i, stake, pnl, bankroll))
    at, stake, pnl, equity = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0) for _ in range(4))
    return at.astype(np.int64), stake, pnl, equity


def results(y: np.ndarray, p: np.ndarray, cfg: BacktestConfig) -> bytes:
    """One bit for each trade that stakes anything: whether it is won."""
    return np.packbits(y[slopes(p, cfg) > 0] == 1).tobytes()


def added(start: float, pnl: np.ndarray) -> np.ndarray:
    """``start`` and the gains up to each trade, added up in order."""
    return np.cumsum(np.append(start, pnl))[1:]


def chunked(played: DataFrame, keys: list[str], order: list[str], cfg: BacktestConfig, most: int = CHUNK) -> DataFrame:
    """Stored chunks of consecutive trades of one key: key hash, chunk (ascending in order), keys, trades, and what following the bankroll needs."""
    played = stored(played, "played")  # ranges are drawn from a sample, so that the input would be computed twice
    by = [*keys, *order]
    rows = played.withColumn("__k", F.xxhash64(*keys)).repartitionByRange(partitions(played), *by).sortWithinPartitions(*by).select("__k", *by, "y", "p")
    trade = T.StructType([played.schema[c] for c in (*order, "y", "p")])
    schema = T.StructType([T.StructField("__k", T.LongType()), T.StructField("chunk", T.LongType()), *(played.schema[c] for c in keys), T.StructField("rows", T.ArrayType(trade))])
    schema = T.StructType([*schema, T.StructField("high", T.DoubleType()), T.StructField("trades", T.LongType()), T.StructField("won", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def chunk(table):
            nonlocal number
            number += 1
            table = table.combine_chunks()
            values = [table.column(c).combine_chunks() for c in (*order, "y", "p")]
            y, p = np.asarray(values[-2], float), np.asarray(values[-1], float)
            _, high, n, _ = summary(y, p, cfg)
            rows = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.StructArray.from_arrays(values, names=[*order, "y", "p"]))
            first = [table.column(c).combine_chunks().slice(0, 1) for c in keys]
            return pa.RecordBatch.from_arrays([table.column("__k").combine_chunks().slice(0, 1), pa.array([number]), *first, rows, pa.array([high]), pa.array([n]), pa.array([results(y, p, cfg)], pa.binary())], names=schema.names)

        for batch in batches:
            while batch.num_rows:
                key = np.asarray(batch.column("__k"))
                if held and held[0].column("__k")[0].as_py() != key[0]:
                    yield chunk(pa.Table.from_batches(held))
                    held = []
                room = most - sum(b.num_rows for b in held)
                size = min(int(np.argmax(key != key[0])) or len(key), room)
                held.append(batch.slice(0, size))
                batch = batch.slice(size)
                if size == room:
                    yield chunk(pa.Table.from_batches(held))
                    held = []
        if held:
            yield chunk(pa.Table.from_batches(held))

    return stored(rows.mapInArrow(pack, schema), "chunks")


def _trades(rows) -> tuple[np.ndarray, np.ndarray]:
    """y and p of one chunk's rows."""
    return np.asarray(rows.values.field("y"), float), np.asarray(rows.values.field("p"), float)


def _followed(chunks: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """(chunk, start, paid0, kind, n, top), stored: each chunk's first bankroll, the gains before it, its trades and highest bankroll. With Kelly stakes chunks may have pieces
    of their map, and no n and top then; without them a key ends at the first that would need some, and what comes later has no start.
    ``start``: where a key's first chunk begins, or null for the first bankroll."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, paid = None, cfg.bankroll, 0.0
        for batch in batches:
            out = []
            column = {c: batch.column(c).to_pylist() for c in ("__k", "chunk", "high", "start", "trades", "won")}
            maps = [batch.column(c) for c in ("left", "a", "c")]
            for i, own in enumerate(column["__k"]):
                if own != key:
                    key, now = own, cfg.bankroll if column["start"][i] is None else column["start"][i]
                    paid = now - cfg.bankroll
                high, trades = column["high"][i], column["trades"][i]
                kind = _LATER if now is None else _DEAD if now < BUST else _HIGH if now >= high + (0.0 if cfg.kelly else SAFE) else _BETWEEN
                start, paid0, n, top = now, paid, 0, now
                if kind == _HIGH or kind == _BETWEEN and not cfg.kelly:
                    won = np.unpackbits(np.frombuffer(column["won"][i], np.uint8), count=trades)
                    if kind == _HIGH:
                        pnl = gains(won, cfg) * cfg.max_position
                        equity = added(now, pnl)
                    else:
                        pnl, equity = replay(won, won, now, cfg)[2:]  # scores only matter to Kelly stakes
                    if len(equity):
                        paid = float(added(paid, pnl)[-1])
                        now, n, top = float(equity[-1]), len(equity), max(now, float(equity.max()))
                elif kind == _BETWEEN:
                    n = top = None
                    if maps[0][i].is_valid:
                        left, a, c = (np.asarray(m[i].values) for m in maps)
                        at = np.searchsorted(left, now, "right") - 1
                        now = float(a[at] * now + c[at])
                        paid = now - cfg.bankroll
                    else:
                        now = None
                out.append((column["chunk"][i], start, paid0, kind, n, top))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["chunk", "start", "paid0", "kind", "n", "top"])

    rows = chunks.select("__k", "chunk", "high", "start", "trades", "won", "left", "a", "c").repartition("__k").sortWithinPartitions("__k", "chunk")
    return stored(rows.mapInArrow(follow, "chunk long, start double, paid0 double, kind int, n long, top double"), "starts")


def _starts(chunks: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """(chunk, start, paid0, kind, n, top) of all chunks."""
    none = {c: F.lit(None).cast("array<double>") for c in ("left", "a", "c")}
    found = _followed(chunks.withColumns(none | {"start": F.lit(None).cast("double")}), cfg)
    between = found.where(F.col("kind") >= _BETWEEN)
    if not cfg.kelly or between.isEmpty():
        return found

    names = ["__k", "chunk", "high", "start", "trades", "won"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [pieces(*_trades(rows), high, cfg) for rows, high in zip(batch.column("rows"), batch.column("high").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([m[i].tolist() for m in maps], pa.list_(pa.float64())) for i in range(3))], names=[*names, "left", "a", "c"])

    entered = chunks.where(F.col("high") > BUST).join(between.select("chunk", "start"), "chunk").select(*names, "rows").repartition(partitions(chunks), "chunk")
    mapped = stored(entered.mapInArrow(build, "__k long, chunk long, high double, start double, trades long, won binary, left array<double>, a array<double>, c array<double>"), "maps")
    plain = chunks.where(F.col("high") <= BUST).join(between.select("chunk", "start"), "chunk").select(*names).withColumns(none)
    return found.where(F.col("kind") < _BETWEEN).union(_followed(mapped.unionByName(plain), cfg))


def backtest(df: DataFrame, keys: list[str], order: list[str], cfg: BacktestConfig = BacktestConfig(), chunk: int = CHUNK) -> DataFrame:
    """One row per trade: keys, order, seq, stake, pnl, equity, peak, drawdown, paid (all pnl so far, added up in order).

    Rows below the threshold, and those without a result, never reach Python. Chunks run in parallel, whatever their keys."""
    played = df.where((F.col("p") >= cfg.threshold) & F.col("y").isNotNull()).select(*keys, *order, F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p"))
    chunks = chunked(played, keys, order, cfg, chunk)
    begun = chunks.select("__k", "chunk", "rows").join(_starts(chunks, cfg), "chunk")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, top = batch.column("n").to_pylist(), batch.column("top").to_pylist()
            for i, (rows, start) in enumerate(zip(batch.column("rows"), batch.column("start").to_pylist(), strict=True)):
                if n[i] is None:
                    equity = replay(*_trades(rows), start, cfg)[3]
                    n[i], top[i] = len(equity), max([start, *equity.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("__k"), batch.column("chunk"), batch.column("start"), batch.column("paid0"), pa.array(n, pa.int64()), pa.array(top, pa.float64())], names=["__k", "chunk", "start", "paid0", "n", "top"])

    light = F.when(F.col("n").isNull(), F.col("rows"))  # the others need no replay
    counts = begun.select("__k", "chunk", "start", "paid0", "n", "top", F.coalesce(light, F.slice("rows", 1, 0)).alias("rows")).mapInArrow(count, "__k long, chunk long, start double, paid0 double, n long, top double")
    before = Window.partitionBy("__k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "start", "paid0", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq0"), F.coalesce(F.max("top").over(before), F.lit(cfg.bankroll)).alias("peak0")).where("n > 0")
    offsets = stored(offsets.withColumn("peak0", F.greatest("peak0", F.lit(cfg.bankroll))), "offsets")
    fields = [*(played.schema[c] for c in (*keys, *order)), T.StructField("seq", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in _OUT[1:])]

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i]
                at, stake, pnl, equity = replay(*_trades(rows), batch.column("start")[i].as_py(), cfg)
                peak = np.maximum(np.maximum.accumulate(equity), batch.column("peak0")[i].as_py()) if len(equity) else equity
                seq = batch.column("seq0")[i].as_py() + 1 + np.arange(len(at))
                where = pa.array(at)
                own = [batch.column(c).take(pa.array(np.full(len(at), i))) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, *(rows.values.field(c).take(where) for c in order), *map(pa.array, (seq, stake, pnl, equity, peak, peak - equity, added(batch.column("paid0")[i].as_py(), pnl)))], names=[*keys, *order, *_OUT])

    return chunks.select("chunk", *keys, "rows").join(offsets, "chunk").repartition(partitions(df), "chunk").mapInArrow(play, T.StructType(fields))


def backtest_summary(trades: DataFrame, keys: list[str], cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Trades, wins, PnL, ROI, drawdown and Sharpe ratio (population deviation, 288 periods)."""
    n = F.count(F.lit(1))
    deviation, total = F.stddev_pop("pnl"), F.max_by("paid", "seq")  # not a sum of the rows in any order
    return trades.groupBy(*keys).agg(
        n.alias("trades"), F.count_if(F.col("pnl") > 0).alias("winning"), F.count_if(F.col("pnl") <= 0).alias("losing"), (F.count_if(F.col("pnl") > 0) / n.cast("double")).alias("trade_win_rate"),
        total.alias("total_pnl"), (total / F.lit(cfg.bankroll)).alias("roi"), F.max("drawdown").alias("max_drawdown"), (F.max("drawdown") / F.max("peak")).alias("max_drawdown_pct"),
        F.when(deviation > 1e-12, F.avg("pnl") / deviation * F.lit(math.sqrt(288.0))).otherwise(F.lit(0.0)).alias("sharpe"),
    )


def threshold_sweep(df: DataFrame, thresholds: list[float], keys: list[str], order: list[str], cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """The summary at each threshold; thresholds are keys, so they run in parallel."""
    low = replace(cfg, threshold=min(thresholds))
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))).where("p >= threshold")
    return backtest_summary(backtest(each, [*keys, "threshold"], order, low), [*keys, "threshold"], low)
