"""Ordered computation that never needs a whole series in one task.

A series is one ``key`` (a symbol) ordered by ``time``.  One symbol may hold a
third of all rows, so no operator here opens a window over a whole symbol of
raw rows.  Rows are cut into time spans, each span is processed by its own
task, and what crosses a span boundary is either

* a *halo* (``framed``): the few neighbouring rows a bounded frame reaches, or
* a *carry* (``running``, ``decayed``): one summary row per span, combined by a
  window over the summaries, which is smaller than the data by the span length.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.columns import epoch
from barloom.operators.quantiles import bucketed

_EXP_ROOM = 600.0   # largest exponent used inside a block; e^600 is well inside a double
_NEGLIGIBLE = 80.0  # e^-80: what a decayed carry may lose without touching a double


@dataclass(frozen=True)
class Layout:
    """How a series is keyed, ordered and cut into spans."""

    key: tuple[str, ...] = ("symbol",)
    time: str = "ts"
    base_seconds: int = 60
    rows: int = 16_384
    by_rows: bool = False   # spans of about ``rows`` rows instead of equal time, for rows that come in bursts

    @property
    def span_seconds(self) -> int:
        return self.base_seconds * self.rows

    def keyed(self, *key: str) -> "Layout":
        return replace(self, key=key)

    def span(self) -> Column:
        return F.floor(epoch(self.time) / F.lit(self.span_seconds))


BARS = Layout()


def spanned(df: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``_span``, later rows never in an earlier span.

    Spans by rows are value buckets of the time, cut by approximate quantiles of each key: the approximation decides
    balance, never a result, since whatever the cuts are, scans carry over them.  Rows of one time stay together.
    """
    if not layout.by_rows:
        return df.withColumn("_span", layout.span())
    most = df.groupBy(*layout.key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    timed = df.withColumn("_us", F.coalesce(F.unix_micros(layout.time), F.lit(-(1 << 62))))
    return bucketed(timed, list(layout.key), "_us", max(1, -(-most // layout.rows))).withColumnRenamed("_bucket", "_span").drop("_us")


def _total(kind: str, value: Column, order: Column, reverse: bool) -> Column:
    if kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](value)


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](value)


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local + carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def running(df: DataFrame, layout: Layout = BARS, *, order: tuple[str, ...] = (), reverse: bool = False,
            inclusive: bool = True, **specs: tuple) -> DataFrame:
    """Cumulative ``sum/count/max/min/last`` per key, as a two-level scan.

    ``specs`` maps an output name to ``(kind, column)`` or ``(kind, column, options)``
    where options may override ``reverse`` and ``inclusive``, so forward and
    backward scans share one pass.  ``last`` skips NULLs, so it is a forward fill
    (backward with ``reverse``).  Level one runs inside each time span; level two
    runs over one row per span; the join back reuses the span partitioning, so
    bulk rows are shuffled once.
    """
    keys = [*layout.key, "_span"]
    base = spanned(df, layout)
    names = [layout.time, *order]
    stamp = F.struct(*names) if order else F.col(layout.time)
    scans = {n: (s[0], s[1], *(({"reverse": reverse, "inclusive": inclusive} | (s[2] if len(s) > 2 else {})).values()))
             for n, s in specs.items()}

    def frame(back: bool, with_row: bool):
        direction = [F.col(c).desc() if back else F.col(c).asc() for c in names]
        return Window.partitionBy(*keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0 if with_row else -1)

    def before(back: bool):
        way = F.col("_span").desc() if back else F.col("_span").asc()
        return Window.partitionBy(*layout.key).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)

    carry = base.groupBy(*keys).agg(*[_total(k, c, stamp, back).alias(f"_t_{n}") for n, (k, c, back, _) in scans.items()])
    carry = carry.select(*keys, *[_fold("sum" if k == "count" else k, F.col(f"_t_{n}")).over(before(back)).alias(f"_c_{n}")
                                  for n, (k, _, back, _) in scans.items()])
    local = base.select("*", *[_fold(k, c).over(frame(back, row)).alias(f"_l_{n}") for n, (k, c, back, row) in scans.items()])
    keep = [c for c in df.columns if c not in specs]
    return local.join(carry, keys, "left").select(
        *keep, *[_merge(k, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, *_) in scans.items()])


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and go on from there.

    A scan reads its input twice (rows and span totals), so a chain of scans would
    read its source exponentially often; deep operators settle between scans.  The
    table survives lost executors and is read back column by column.
    """
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A single-process session that names none gets a fresh temporary one; a cluster must name it, since its
    executors could not read what others write to a local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def index_rows(df: DataFrame, layout: Layout = BARS, name: str = "_i", order: tuple[str, ...] = ()) -> DataFrame:
    """Zero-based position of each row in its series."""
    if name in df.columns:
        return df
    out = running(df, layout, order=order, **{name: ("count", F.lit(1))})
    return out.withColumn(name, F.col(name) - 1)


def framed(df: DataFrame, build: Callable[[DataFrame, WindowSpec], DataFrame], layout: Layout = BARS, *,
           back: int = 0, ahead: int = 0) -> DataFrame:
    """Run bounded row frames chunk by chunk.

    ``build(frame, w)`` adds columns with windows derived from ``w`` that reach at
    most ``back`` rows behind and ``ahead`` rows ahead.  Each chunk receives
    exactly those neighbour rows as a halo, whatever gaps the calendar has.
    """
    base = index_rows(df, layout)
    if back == 0 and ahead == 0:
        back = 1
    n = F.lit(layout.rows)
    first = F.floor(F.greatest(F.col("_i") - F.lit(ahead), F.lit(0)) / n)
    last = F.floor((F.col("_i") + F.lit(back)) / n)
    spread = base.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*layout.key, "_chunk").orderBy("_i")
    return build(spread, w).where(F.floor(F.col("_i") / n) == F.col("_chunk")).drop("_chunk")


def rolling_sums(frame: DataFrame, w: WindowSpec, specs: dict[str, tuple[Column, int]]) -> DataFrame:
    """Trailing sums over exactly ``n`` present values, NULL where one is missing.

    One method for all lengths: differences of a chunk-local prefix sum and of a prefix
    count of present values, O(1) per row.  A value much larger than its
    neighbours costs the sums behind it in the same chunk that much precision, so callers centre large levels first.
    """
    prefix = w.rowsBetween(Window.unboundedPreceding, 0)
    out = frame.select("*", *[e.over(prefix).alias(f"_{p}_{o}") for o, (c, _) in specs.items()
                              for p, e in (("p", F.sum(F.coalesce(c, F.lit(0.0)))), ("n", F.count(c)))])

    def since(name: str, n: int) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, n).over(w), F.lit(0))

    return out.select("*", *[F.when(since(f"_n_{o}", n) == n, since(f"_p_{o}", n)).alias(o) for o, (_, n) in specs.items()]).drop(
        *[f"_{p}_{o}" for o in specs for p in "pn"])


def run_bounds(df: DataFrame, starts: Column, layout: Layout = BARS) -> DataFrame:
    """Gaps-and-islands without grouping by run: a run may hold most of a series.

    ``starts`` marks the first row of every run.  Adds ``run_start`` / ``run_end``
    (row positions, both inclusive), so a run's size never needs its rows together.
    """
    base = index_rows(df, layout).withColumn("_new", starts)
    mark = F.when(F.col("_new") | (F.col("_i") == 0), F.col("_i"))
    after = {"reverse": True, "inclusive": False}
    both = running(base, layout, run_start=("last", mark), _next=("last", mark, after), _last=("max", F.col("_i"), after))
    end = F.coalesce(F.col("_next") - 1, F.col("_last"), F.col("_i"))
    return both.withColumn("run_end", end).drop("_new", "_next", "_last")


def _block(decays: list[float], rows: int) -> int:
    fastest = max(-math.log(a) for a in decays)
    return max(2, min(rows, int(_EXP_ROOM / fastest)))


def decayed(df: DataFrame, specs: dict[str, tuple[Column, float]], layout: Layout = BARS,
            max_lags: int = 64) -> DataFrame:
    """``y_t = a * y_(t-1) + b_t`` for constant ``0 < a <= 1``; ``specs`` maps name to ``(b, a)``.

    Inside a block the recursion is a scaled running sum.  A block's carry-in is
    a sum over earlier block totals, and a decay below e^-80 cannot reach a
    double, so only a few lags of the block table are needed.  ``a = 1`` is a
    plain cumulative sum.
    """
    base = index_rows(df, layout)
    plain = {n: ("sum", b) for n, (b, a) in specs.items() if a >= 1.0}
    if plain:
        base = running(base, layout, **plain)
    todo = sorted(((n, b, a) for n, (b, a) in specs.items() if a < 1.0), key=lambda s: s[2])
    while todo:
        size = _block([todo[0][2]], layout.rows)
        group = [s for s in todo if math.ceil(_NEGLIGIBLE / (size * -math.log(s[2]))) <= max_lags]
        if not group:  # slower than 64 chunks of memory: a longer block, still a streaming window
            size = math.ceil(_NEGLIGIBLE / (max_lags * -math.log(todo[0][2])))
            group = todo[:1]
        base = _decayed_group(base, group, size, layout)
        done = {g[0] for g in group}
        todo = [s for s in todo if s[0] not in done]
    return base


def _decayed_group(df: DataFrame, group, size: int, layout: Layout) -> DataFrame:
    keys = [*layout.key, "_blk"]
    k = (F.col("_i") % F.lit(size)).cast("double")
    base = df.withColumn("_blk", F.floor(F.col("_i") / F.lit(size)))
    w = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*layout.key).orderBy("_blk")
    totals = base.groupBy(*keys).agg(*[
        F.sum(F.coalesce(b, F.lit(0.0)) * F.exp(F.lit(math.log(a)) * (F.lit(size - 1.0) - k))).alias(f"_t_{n}")
        for n, b, a in group])
    carries = []
    for n, _, a in group:
        lags = math.ceil(_NEGLIGIBLE / (size * -math.log(a)))
        terms = [F.coalesce(F.lag(f"_t_{n}", lag).over(order), F.lit(0.0)) * F.lit(math.exp(math.log(a) * size * (lag - 1)))
                 for lag in range(1, lags + 1)]
        carries.append(sum(terms[1:], terms[0]).alias(f"_c_{n}"))
    carry = totals.select(*keys, *carries)
    local = base.select("*", *[F.sum(F.coalesce(b, F.lit(0.0)) * F.exp(F.lit(-math.log(a)) * k)).over(w).alias(f"_l_{n}")
                               for n, b, a in group])
    names = [g[0] for g in group]
    joined = local.join(carry, keys, "left")
    return joined.select(*[c for c in df.columns if c not in names], *[
        (F.exp(F.lit(math.log(a)) * (k + 1)) * F.coalesce(F.col(f"_c_{n}"), F.lit(0.0))
         + F.exp(F.lit(math.log(a)) * k) * F.col(f"_l_{n}")).alias(n) for n, _, a in group])


def asof(base: DataFrame, events: DataFrame, layout: Layout = BARS, cols: list[str] | None = None) -> DataFrame:
    """Backward as-of join: each base row sees the last event at or before it.

    Union, tag and forward fill, so cost is one shuffle of both sides and no
    pair is ever formed.  At equal time the event sorts first (inclusive match).
    """
    cols = cols or [c for c in events.columns if c not in (*layout.key, layout.time)]
    rest = [c for c in base.columns if c not in (*layout.key, layout.time)]
    ids = [*layout.key, layout.time]
    ev_type = events.select(F.struct(*cols).alias("_ev")).schema["_ev"].dataType
    row_type = base.select(F.struct(*(rest or ids)).alias("_row")).schema["_row"].dataType
    left = base.select(*ids, F.lit(1).alias("_tag"), F.struct(*(rest or ids)).alias("_row"),
                       F.lit(None).cast(ev_type).alias("_ev"))
    right = events.select(*ids, F.lit(0).alias("_tag"), F.lit(None).cast(row_type).alias("_row"),
                          F.struct(*cols).alias("_ev"))
    merged = running(left.unionByName(right), layout, order=("_tag",), _ev=("last", F.col("_ev")))
    return merged.where("_tag = 1").select(
        *ids, *[F.col(f"_row.`{c}`").alias(c) for c in rest], *[F.col(f"_ev.`{c}`").alias(c) for c in cols])


def lagged(df: DataFrame, cols: dict[str, tuple[str, int]], layout: Layout = BARS) -> DataFrame:
    """Row lags (positive) and leads (negative): ``out -> (column, offset)``."""
    back = max([o for _, o in cols.values() if o > 0], default=0)
    ahead = max([-o for _, o in cols.values() if o < 0], default=0)

    def build(f, w):
        return f.select("*", *[(F.lag(c, o) if o >= 0 else F.lead(c, -o)).over(w).alias(n)
                               for n, (c, o) in cols.items()])

    return framed(df, build, layout, back=back, ahead=ahead)
