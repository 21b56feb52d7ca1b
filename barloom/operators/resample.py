"""Ticks to bars, bars to coarser bars, and alignment of coarse values to base rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import col, epoch, floor_to, shift
from barloom.operators.ordered import BARS, Layout, asof, lagged

_MIN, _HOUR, _DAY = 60, 3_600, 86_400

# Supported interval labels and their widths in seconds.  A week
# starts on Monday; a month is a calendar month; three days count from the first
# data day of the series.
INTERVALS = {
    "1m": _MIN, "3m": 3 * _MIN, "5m": 5 * _MIN, "15m": 15 * _MIN, "30m": 30 * _MIN,
    "1h": _HOUR, "2h": 2 * _HOUR, "4h": 4 * _HOUR, "6h": 6 * _HOUR, "8h": 8 * _HOUR,
    "12h": 12 * _HOUR, "1d": _DAY, "3d": 3 * _DAY, "1w": 7 * _DAY, "1month": None,
}
_MONDAY = 4 * _DAY  # 1970-01-05


def interval_rules(labels: list[str]) -> dict[str, int | None]:
    """Validated, ordered, duplicate-free interval map."""
    if not labels:
        raise ValueError("no intervals given")
    unknown = [x for x in labels if x not in INTERVALS]
    if unknown:
        raise ValueError(f"unknown intervals: {unknown}")
    return {x: INTERVALS[x] for x in dict.fromkeys(labels)}


def bucket_start(ts, label: str, origin: Column | None = None) -> Column:
    seconds = interval_rules([label])[label]
    if seconds is None:
        return F.date_trunc("month", col(ts))
    if label == "1w":
        return floor_to(ts, seconds, _MONDAY)
    if label == "3d" and origin is not None:
        e = epoch(ts) - origin
        return F.timestamp_seconds(F.floor(e / F.lit(seconds)) * F.lit(seconds) + origin)
    return floor_to(ts, seconds)


def bucket_end(start, label: str) -> Column:
    seconds = INTERVALS[label]
    if seconds is None:
        return F.timestamp_micros(F.unix_micros((col(start) + F.expr("INTERVAL 1 MONTH"))))
    return shift(start, seconds)


def ohlc(order, volume: Column, price: str = "price") -> list[Column]:
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), volume.alias("volume")]


def tick_bars(ticks: DataFrame, seconds: int, *, volume: str = "size", order: tuple[str, ...] = ("ts", "event_id"),
              covered: bool = False, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First/max/min/last price per left-closed bucket.

    ``volume`` is a size column to sum, or ``"count"``.  ``covered`` keeps only buckets
    that lie fully between the first and the last tick of the series.  All aggregates
    combine map-side, so a burst of ticks in one bucket stays cheap.
    """
    vol = F.count(F.lit(1)).cast("double") if volume == "count" else F.sum(volume).cast("double")
    stamped = ticks.withColumn("_b", floor_to("ts", seconds))
    bars = stamped.groupBy(*key, F.col("_b")).agg(*ohlc(F.struct(*order), vol)).withColumnRenamed("_b", "ts")
    if covered:
        span = ticks.groupBy(*key).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
        bars = (bars.join(span, list(key)).where((F.col("ts") >= F.col("_lo")) & (shift("ts", seconds) <= F.col("_hi")))
                .drop("_lo", "_hi"))
    return bars


def coarser_bars(bars: DataFrame, seconds: int, base_seconds: int, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars by coverage: only edge buckets that stick out of the data are dropped."""
    span = bars.groupBy(*key).agg(F.min("ts").alias("_lo"), shift(F.max("ts"), base_seconds).alias("_hi"))
    agg = _group_bars(bars.withColumn("_b", floor_to("ts", seconds)), key)
    return (agg.join(span, list(key)).where((F.col("ts") >= F.col("_lo")) & (shift("ts", seconds) <= F.col("_hi")))
            .drop("_lo", "_hi", "_n"))


def exact_count_bars(bars: DataFrame, seconds: int, count: int, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars kept only when exactly ``count`` base rows are present."""
    return (_group_bars(bars.withColumn("_b", floor_to("ts", seconds)), key)
            .where(F.col("_n") == count).drop("_n"))


def _group_bars(df: DataFrame, key, extra: list[Column] = ()) -> DataFrame:
    return (df.groupBy(*key, "_b").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("_n"), *extra)
        .withColumnRenamed("_b", "ts"))


def complete_bars(bars: DataFrame, label: str, base_seconds: int = 60, *, aggs: list[Column] = (),
                  key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarse bars that hold every base row of their bucket, with the time they become visible.

    ``close_ts`` is the bucket's last base row: a coarse value may be used from there on.
    """
    if label == "3d":
        first = bars.groupBy(*key).agg(F.unix_seconds(F.date_trunc("day", F.min("ts"))).alias("_origin"))
        stamped = bars.join(first, list(key)).withColumn("_b", bucket_start("ts", label, F.col("_origin"))).drop("_origin")
    else:
        stamped = bars.withColumn("_b", bucket_start("ts", label))
    agg = _group_bars(stamped, key, list(aggs))
    end = bucket_end("ts", label)
    width = (F.unix_seconds(end) - epoch("ts")) / F.lit(base_seconds)
    return (agg.where(F.col("_n") == width).where(F.col("open").isNotNull() & F.col("close").isNotNull())
            .withColumn("close_ts", shift(end, -base_seconds)).drop("_n"))


def align_to_base(base: DataFrame, coarse: DataFrame, cols: list[str], layout: Layout = BARS) -> DataFrame:
    """Give every base row the last coarse value that was visible at its time."""
    events = coarse.select(*layout.key, F.col("close_ts").alias(layout.time), *cols)
    return asof(base.drop("_i"), events, layout, cols)


def latest_complete(bars: DataFrame, label: str, base_seconds: int = 60, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The newest complete coarse bar per series."""
    full = complete_bars(bars, label, base_seconds, key=key)
    names = [c for c in full.columns if c not in key]
    return full.groupBy(*key).agg(F.max_by(F.struct(*names), "ts").alias("_r")).select(*key, "_r.*")


def coarse_lags(coarse: DataFrame, cols: list[str], lags: int, prefix: str, layout: Layout = BARS) -> tuple[DataFrame, list[str]]:
    """``lag1`` is the latest closed coarse bar, ``lagK`` lies K-1 bars before it."""
    specs = {f"{prefix}_{c}_lag{k}": (c, k - 1) for c in cols for k in range(1, lags + 1)}
    return lagged(coarse, specs, layout), list(specs)


def decision_clock(df: DataFrame, bucket_seconds: int, base_seconds: int, time: str = "ts") -> DataFrame:
    """Bucket of each row, whether the row closes it, and where the next bucket starts."""
    start = floor_to(time, bucket_seconds)
    return df.withColumns({
        "bucket": start,
        "is_decision": epoch(time) == epoch(start) + F.lit(bucket_seconds - base_seconds),
        "next_bucket": shift(start, bucket_seconds),
    })


