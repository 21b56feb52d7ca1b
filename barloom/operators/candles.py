"""Candle shape, lag, pattern and streak features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import EPS, safe_div, sign
from barloom.operators.ordered import BARS, Layout, framed, lagged, run_bounds
from barloom.operators.resample import align_to_base, coarse_lags, complete_bars

SHAPE_COLS = ["candle_ret_co", "candle_range_ho", "candle_body_abs_open", "candle_body_pressure",
              "candle_signed_vol", "candle_up_down_vol_log_ratio", "candle_wick_asym",
              "candle_close_location_value"]


def volume_split() -> dict[str, Column]:
    """Volume on the side of the candle body."""
    body = F.col("close") - F.col("open")
    return {"up_volume": F.when(body > 0, F.col("volume")).otherwise(0.0),
            "down_volume": F.when(body < 0, F.col("volume")).otherwise(0.0)}


def shape_features(df: DataFrame) -> DataFrame:
    """Eight shape columns.  ``signed_vol`` and ``up_down_vol_log_ratio`` are pure signs."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    split = volume_split()
    up = F.col("up_volume") if "up_volume" in df.columns else split["up_volume"]
    down = F.col("down_volume") if "down_volume" in df.columns else split["down_volume"]
    body, rng = c - o, h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    return df.withColumns({
        "candle_ret_co": safe_div(body, o),
        "candle_range_ho": safe_div(rng, o),
        "candle_body_abs_open": safe_div(F.abs(body), o),
        "candle_body_pressure": body / (rng + EPS),
        "candle_signed_vol": F.signum(body),
        "candle_up_down_vol_log_ratio": F.signum(up - down),
        "candle_wick_asym": (upper - lower) / (rng + EPS),
        "candle_close_location_value": (c - lo) / (rng + EPS),
    })


def split_volume_bars(bars: DataFrame, label: str, base_seconds: int) -> DataFrame:
    """Complete coarse bars with base-level up and down volume summed inside each."""
    s = volume_split()
    return complete_bars(bars, label, base_seconds,
                         aggs=[F.sum(s["up_volume"]).alias("up_volume"), F.sum(s["down_volume"]).alias("down_volume")])


def shape_lags(df: DataFrame, cols: list[str], lags: int, layout: Layout = BARS) -> DataFrame:
    return lagged(shape_features(df), {f"{c}_1m_lag{k}": (c, k) for c in cols for k in range(1, lags + 1)}, layout)


def coarse_shape_lags(bars: DataFrame, label: str, base_seconds: int, cols: list[str], lags: int,
                      layout: Layout = BARS) -> DataFrame:
    coarse = shape_features(split_volume_bars(bars, label, base_seconds))
    wide, names = coarse_lags(coarse, cols, lags, label, layout)
    return align_to_base(bars, wide, names, layout)


# Pattern thresholds: fixed values of the public candlestick conventions.
_AVG_ROWS = 10          # rows behind the trailing average of body or range
_DOJI_SHARE = 0.1       # doji body against average range
_SHORT_SHADOW = 0.1     # very short shadow against average range
_STAR_PENETRATION = 0.3


class _Bar:
    """Columns of the candle ``k`` rows back, inside one window pass."""

    def __init__(self, k: int):
        self.o, self.h, self.l, self.c = (F.col(f"_{x}{k}") for x in "ohlc")
        self.body = F.abs(self.c - self.o)
        self.rng = self.h - self.l
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.upper, self.lower = self.h - self.top, self.bottom - self.l
        self.up, self.down = self.c >= self.o, self.c < self.o
        self.avg_body, self.avg_rng = F.col(f"_ab{k}"), F.col(f"_ar{k}")
        self.doji = self.body <= self.avg_rng * _DOJI_SHARE
        self.long = self.body > self.avg_body
        self.short = self.body < self.avg_body
        self.no_upper = self.upper < self.avg_rng * _SHORT_SHADOW
        self.no_lower = self.lower < self.avg_rng * _SHORT_SHADOW


def _patterns() -> dict[str, Column]:
    a, b, c = _Bar(2), _Bar(1), _Bar(0)  # oldest to newest

    def flag(bull: Column | None, bear: Column | None = None) -> Column:
        out = F.when(bull, 100) if bull is not None else F.when(bear, -100)
        if bull is not None and bear is not None:
            out = out.when(bear, -100)
        return F.coalesce(out, F.lit(0)).cast("int")

    gap_down = c.top < b.bottom
    gap_up = c.bottom > b.top
    star_body_low = b.top < a.bottom
    star_body_high = b.bottom > a.top
    inside = (c.top < b.top) & (c.bottom > b.bottom)
    return {
        "doji": flag(c.doji),
        "dragonfly_doji": flag(c.doji & c.no_upper & ~c.no_lower),
        "gravestone_doji": flag(c.doji & c.no_lower & ~c.no_upper),
        "marubozu": flag(c.long & c.no_upper & c.no_lower & c.up, c.long & c.no_upper & c.no_lower & c.down),
        "spinning_top": flag(c.short & (c.upper > c.body) & (c.lower > c.body) & c.up,
                             c.short & (c.upper > c.body) & (c.lower > c.body) & c.down),
        "hammer": flag(c.short & (c.lower > c.body) & c.no_upper & (c.bottom <= b.l + b.avg_rng * 0.2)),
        "shooting_star": flag(None, c.short & (c.upper > c.body) & c.no_lower & gap_up),
        "engulfing": flag(c.up & b.down & (c.c > b.o) & (c.o < b.c), c.down & b.up & (c.o > b.c) & (c.c < b.o)),
        "harami": flag(b.long & c.short & inside & b.down, b.long & c.short & inside & b.up),
        "piercing": flag(b.down & b.long & c.up & c.long & (c.o < b.l) & (c.c < b.o) & (c.c > b.c + b.body * 0.5)),
        "dark_cloud_cover": flag(None, b.up & b.long & c.down & (c.o > b.h) & (c.c > b.o) & (c.c < b.c - b.body * 0.5)),
        "morning_star": flag(a.long & a.down & b.short & star_body_low & c.up
                             & (c.c > a.c + a.body * _STAR_PENETRATION)),
        "evening_star": flag(None, a.long & a.up & b.short & star_body_high & c.down
                             & (c.c < a.c - a.body * _STAR_PENETRATION)),
        "three_white_soldiers": flag(a.up & b.up & c.up & (c.c > b.c) & (b.c > a.c) & (b.o > a.o) & (b.o <= a.c)
                                     & (c.o > b.o) & (c.o <= b.c) & c.no_upper & b.no_upper & a.no_upper),
        "three_black_crows": flag(None, a.down & b.down & c.down & (c.c < b.c) & (b.c < a.c) & (b.o < a.o)
                                  & (b.o > a.c) & (c.o < b.o) & (c.o > b.c) & c.no_lower & b.no_lower & a.no_lower),
    }


PATTERNS = ["doji", "dragonfly_doji", "gravestone_doji", "marubozu", "spinning_top", "hammer", "shooting_star",
            "engulfing", "harami", "piercing", "dark_cloud_cover", "morning_star", "evening_star",
            "three_white_soldiers", "three_black_crows"]


def pattern_features(df: DataFrame, names: list[str] = PATTERNS, layout: Layout = BARS) -> DataFrame:
    """Candlestick flags in {-100, 0, 100}; averages look at the ten rows before each candle."""
    temps = [f"_{x}{k}" for k in range(3) for x in ("o", "h", "l", "c", "ab", "ar")]

    def build(f, w):
        past = w.rowsBetween(-_AVG_ROWS, -1)
        f = f.select("*", F.avg(F.abs(F.col("close") - F.col("open"))).over(past).alias("_ab0"),
                     F.avg(F.col("high") - F.col("low")).over(past).alias("_ar0"),
                     *[F.col(s).alias(f"_{s[0]}0") for s in ("open", "high", "low", "close")])
        f = f.select("*", *[F.lag(f"_{x}0", k).over(w).alias(f"_{x}{k}")
                            for k in (1, 2) for x in ("o", "h", "l", "c", "ab", "ar")])
        ready = F.col("_i") >= _AVG_ROWS + 2
        flags = _patterns()
        return f.select("*", *[F.when(ready, flags[n]).otherwise(0).cast("int").alias(f"cdl_{n}") for n in names]).drop(*temps)

    return framed(df, build, layout, back=_AVG_ROWS + 2)


def signed_streak(df: DataFrame, out: str = "streak", layout: Layout = BARS) -> DataFrame:
    """Length of the current run of candle direction, signed; a flat candle resets to zero."""
    s = lagged(df.withColumn("_sg", sign(F.col("close") - F.col("open"))), {"_pv": ("_sg", 1)}, layout)
    starts = F.col("_pv").isNull() | (F.col("_pv") != F.col("_sg"))
    runs = run_bounds(s, starts, layout)
    value = (F.col("_i") - F.col("run_start") + 1) * F.col("_sg")
    return runs.withColumn(out, value.cast("int")).drop("_sg", "_pv", "run_start", "run_end")


def interval_streak(bars: DataFrame, label: str, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    """Streak of the coarse interval seen from base rows; zero before the first coarse bar."""
    name = f"streak_{label}"
    coarse = signed_streak(complete_bars(bars, label, base_seconds), name, layout)
    return align_to_base(bars, coarse, [name], layout).withColumn(name, F.coalesce(name, F.lit(0)))


def latest_streak(bars: DataFrame, label: str, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    coarse = signed_streak(complete_bars(bars, label, base_seconds), "streak", layout)
    return coarse.groupBy(*layout.key).agg(F.max_by("streak", "ts").alias("streak"), F.max("ts").alias("ts"))
