"""Small Column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_seconds(col(ts))


def floor_to(ts, seconds: int, origin: int = 0) -> Column:
    """Left edge of the fixed-width bucket that holds ``ts``."""
    e = epoch(ts) - F.lit(origin)
    return F.timestamp_seconds(F.floor(e / F.lit(seconds)) * F.lit(seconds) + F.lit(origin))


def shift(ts, seconds) -> Column:
    """``ts`` moved by a number of seconds (exact for whole-second bars)."""
    step = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return F.timestamp_micros(F.unix_micros(col(ts)) + step.cast("bigint") * F.lit(1_000_000))


def finite(c) -> Column:
    """Value, or NULL when it is NaN or infinite."""
    c = col(c)
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)


def safe_div(num, den, eps: float = EPS) -> Column:
    """Quotient, NULL when the denominator is within ``eps`` of zero."""
    return F.when(F.abs(col(den)) > eps, col(num) / col(den))


def quotient(num, den) -> Column:
    """Quotient as floating point has it: infinite, or NaN for zero by zero, where the denominator is zero."""
    return F.when(col(den) == 0, col(num) * F.pow(col(den), F.lit(-1.0))).otherwise(col(num) / col(den))


def sign(c) -> Column:
    return F.signum(col(c)).cast("int")


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def wavg(value, weight) -> Column:
    """Weighted mean as an aggregate."""
    return F.sum(col(value) * col(weight)) / F.sum(col(weight))


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row frame (an aggregate without grouping), never more than one."""
    return df.join(F.broadcast(one.limit(1)), F.lit(True))


def non_negative(c: Column) -> Column:
    """Rounding below zero removed; NULL stays NULL."""
    return F.when(c < 0, 0.0).otherwise(c)
