"""Column helpers for arithmetic that keeps infinities, and for safe parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ratio(n, d) -> Column:
    """n / d with 0 / 0 null and x / 0 infinite, where Spark's own division raises or is null."""
    n, d = _col(n).cast("double"), _col(d).cast("double")
    return F.when(d == 0, F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))).otherwise(n / F.nullif(d, F.lit(0.0)))


def clip(x, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def finite_or(x, other: float = 0.0) -> Column:
    return F.when(finite(x), _col(x)).otherwise(F.lit(other))


def rounded(x, digits: int = 6) -> Column:
    """F.round without negative zeros, a double each time. F.round goes through a decimal's text; only what is near half of the last digit, or large, does so here."""
    x, unit = _col(x), F.lit(10.0**digits)
    moved = x * unit
    whole = F.rint(moved)
    plain = (F.abs(moved) < F.lit(1e12)) & (F.abs(moved - whole) < F.lit(0.499))  # the product is off by less than the rest
    return F.when(plain, (whole + F.lit(0.0)) / unit).otherwise(F.round(x, digits) + F.lit(0.0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -30.0, 30.0)))


def number(x, kind: str = "double") -> Column:
    """A number from text, null where it isn't one."""
    return F.trim(_col(x)).try_cast(kind)


def unix_time(x) -> Column:
    return F.timestamp_seconds(number(x, "bigint"))


def parsed_time(x) -> Column:
    """ISO date and time with Z or an offset, fraction or none; a bare date is not accepted."""
    x = F.trim(_col(x))
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z| ?[+-]\d{2}(:?\d{2})?)$"), F.regexp_replace(F.regexp_replace(x, r" ([+-])", "$1"), r"([+-]\d{2})(\d{2})?$", "$1:00")).try_cast("timestamp")
