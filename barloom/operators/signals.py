"""Cross, threshold and reversal signals in {-1, 0, 1}, and the segments they open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.ordered import BARS, Layout, index_rows, lagged, running


class Line:
    """A column now and on earlier rows."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, back: int = 0) -> Column:
        return F.col(self.name) if back == 0 else F.col(f"_{self.name}_{back}")


def _pick(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def zero_cross(x: Line) -> Column:
    return _pick((x() > 0) & (x(1) < 0), (x() < 0) & (x(1) > 0))


def cross(x: Line, y: Line) -> Column:
    return _pick((x() > y()) & (x(1) < y(1)), (x() < y()) & (x(1) > y(1)))


def cross_on_side(x: Line, y: Line) -> Column:
    return _pick((y() < 0) & (x() < 0) & (x() > y()) & (x(1) < y(1)), (y() > 0) & (x() > 0) & (x() < y()) & (x(1) > y(1)))


def approaching(x: Line, y: Line) -> Column:
    return _pick((x() > x(1)) & (y() < y(1)), (x() < x(1)) & (y() > y(1)))


def approaching_on_side(x: Line, y: Line) -> Column:
    return _pick((y() < 0) & (x() < 0) & (x() > x(1)) & (y() < y(1)), (y() > 0) & (x() > 0) & (x() < x(1)) & (y() > y(1)))


def reversal(x: Line) -> Column:
    return _pick((x() > x(1)) & (x(1) < x(2)) & (x(2) < x(3)), (x() < x(1)) & (x(1) > x(2)) & (x(2) > x(3)))


def trend(adx: Line, minus: Line, plus: Line, level: float) -> Column:
    strong = adx() >= level
    return _pick(strong & (plus() > minus()), strong & (plus() < minus()))


def _above(adx: Line, level: float, rule: Column) -> Column:
    return F.when(adx() < level, 0).otherwise(rule)


def di_cross(adx: Line, minus: Line, plus: Line, level: float) -> Column:
    return _above(adx, level, cross(plus, minus))


def di_approaching(adx: Line, minus: Line, plus: Line, level: float) -> Column:
    up = (plus() > plus(1)) & (minus() < minus(1)) & (plus() < minus())
    down = (plus() < plus(1)) & (minus() > minus(1)) & (plus() > minus())
    return _above(adx, level, _pick(up, down))


def level_cross(x: Line, low: float, high: float, buy: str, sell: str) -> Column:
    """``buy`` / ``sell`` are ``int`` (leaving the band) or ``ext`` (re-entering it)."""
    ups = {"int": (x(1) > low) & (x() < low), "ext": (x(1) < low) & (x() > low)}
    downs = {"int": (x(1) < high) & (x() > high), "ext": (x(1) > high) & (x() < high)}
    return _pick(ups[buy], downs[sell])


def kd_cross(k: Line, d: Line, low: float = 20.0, high: float = 80.0, where: str = "any") -> Column:
    up, down = (k(1) < d(1)) & (k() > d()), (k(1) > d(1)) & (k() < d())
    if where == "inside":
        inside = (k() > low) & (k() < high) & (d() > low) & (d() < high)
        return _pick(up & inside, down & inside)
    if where == "outside":
        return _pick(up & (k() < low) & (d() < low), down & (k() > high) & (d() > high))
    return _pick(up, down)


def add_signals(df: DataFrame, lines: dict[str, int], build: Callable[..., dict[str, Column]], layout: Layout = BARS) -> DataFrame:
    """``lines`` names the columns used and how many rows back; ``build(**lines)`` returns the signals."""
    d = lagged(df, {f"_{c}_{k}": (c, k) for c, n in lines.items() for k in range(1, n + 1)}, layout)
    sig = build(**{c: Line(c) for c in lines})
    return d.select(*df.columns, *[c.cast("int").alias(n) for n, c in sig.items()])


def segments(df: DataFrame, signal: str, layout: Layout = BARS) -> DataFrame:
    """A +1 opens when none is open, the next -1 closes; unfinished segments are dropped."""
    s = F.col(signal)
    d = index_rows(df, layout)
    d = running(d, layout, inclusive=False, _prev=("last", F.when(s != 0, s)),
                _end=("last", F.when(s == -1, F.struct(F.col("_i"), F.col(layout.time))), {"reverse": True}))
    opens = (s == 1) & (F.coalesce("_prev", F.lit(-1)) == -1)
    return d.where(opens & F.col("_end").isNotNull()).select(
        *layout.key, F.col("_i").alias("start_idx"), F.col("_end._i").alias("end_idx"),
        F.col(layout.time).alias("start_ts"), F.col(f"_end.{layout.time}").alias("end_ts"))
