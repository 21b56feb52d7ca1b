"""Oscillators and channels with free averages, built many at a time with shared sub-results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.averages import Averages, price_source
from barloom.operators.ordered import BARS, Layout, index_rows, lagged, running


def true_range() -> Column:
    """Needs ``_pc`` (previous close); NULL on the first row."""
    h, lo, pc = F.col("high"), F.col("low"), F.col("_pc")
    return F.when(pc.isNotNull(), F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)))


def directional_moves() -> tuple[Column, Column]:
    up = F.col("high") - F.coalesce("_ph", "high")
    down = F.coalesce("_pl", "low") - F.col("low")
    return (F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0))


def with_ranges(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Adds ``tr``, ``up_move`` and ``down_move``."""
    d = lagged(df, {"_pc": ("close", 1), "_ph": ("high", 1), "_pl": ("low", 1)}, layout)
    up, down = directional_moves()
    return d.withColumns({"tr": true_range(), "up_move": up, "down_move": down}).drop("_pc", "_ph", "_pl")


def with_accumulation(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Accumulation/distribution line: running sum of close location times volume."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    flow = F.when(h > lo, ((c - lo) - (h - c)) / (h - lo) * F.col("volume")).otherwise(0.0)
    return running(df, layout, adl=("sum", flow))


def _zscore(av: Averages, name: str, center: str, spread: str) -> str:
    num, den = F.col(center) - F.col("close"), F.col(spread)
    return av.expression(name, F.when(den == 0, F.when(num == 0, 0.0)).otherwise(num / den), [center, spread])


def _adx(av: Averages, name: str, p: dict) -> dict[str, str]:
    atr = av.want(p["ma_type_atr"], "tr", p["atr_period"])
    pos = av.want(p["ma_type_posDM"], "up_move", p["posDM_period"])
    neg = av.want(p["ma_type_negDM"], "down_move", p["negDM_period"])
    tiny = 1e-12

    def di(move):
        live = F.abs(F.col(atr)) > tiny
        ratio = F.when(F.col(move).isNotNull(), F.greatest(F.col(move), F.lit(0.0))) / F.col(atr)
        return F.when(live, ratio).otherwise(0.0) * 100.0

    plus = av.expression(f"{name}_plus_di", di(pos), [atr, pos])
    minus = av.expression(f"{name}_minus_di", di(neg), [atr, neg])
    total = F.abs(F.col(plus)) + F.abs(F.col(minus))
    dx = F.when(total > tiny, F.abs(F.col(plus) - F.col(minus)) / total).otherwise(0.0)
    raw = av.expression(f"{name}_dx", F.least(F.greatest(dx, F.lit(0.0)), F.lit(1.0)) * 100.0, [plus, minus])
    for n in (plus, minus, raw):
        av.nodes[n].lead = 0  # warm-up rows count as zero directional movement
    adx = av.want(p["ma_type_adx"], raw, p["adx_period"])
    return {f"{name}_adx": adx, f"{name}_plus_di": plus, f"{name}_minus_di": minus}


def _bollinger(av: Averages, name: str, p: dict) -> dict[str, str]:
    src = f"_src_{p['ma_source']}"
    center = av.want(p["ma_type"], src, p["ma_period"])
    dev = F.col(f"_src_{p['std_source']}") - F.col(center)
    sq = av.expression(f"{name}_sq", dev * dev, [center])
    var = av.want(p["std_ma_type"], sq, p["std_ma_period"])
    std = av.expression(f"{name}_std", F.when(F.col(var) >= 0, F.sqrt(F.greatest(F.col(var), F.lit(0.0)))), [var])
    return {name: _zscore(av, f"{name}_z", center, std)}


def _keltner(av: Averages, name: str, p: dict) -> dict[str, str]:
    center = av.want(p["ma_type"], f"_src_{p['source']}", p["ma_period"])
    atr = av.want(p["atr_ma_type"], "tr", p["atr_period"])
    return {name: _zscore(av, f"{name}_z", center, atr)}


def _chaikin(av: Averages, name: str, p: dict) -> dict[str, str]:
    fast = av.want(p["fast_ma_type"], "adl", p["fast_period"])
    slow = av.want(p["slow_ma_type"], "adl", p["slow_period"])
    return {name: av.expression(f"{name}_osc", F.col(fast) - F.col(slow), [fast, slow])}


def _macd(av: Averages, name: str, p: dict) -> dict[str, str]:
    fast = av.want(p["fast_ma_type"], f"_src_{p['fast_source']}", p["fast_period"])
    slow = av.want(p["slow_ma_type"], f"_src_{p['slow_source']}", p["slow_period"])
    line = av.expression(f"{name}_line", F.col(fast) - F.col(slow), [fast, slow])
    sig = av.want(p["signal_ma_type"], line, p["signal_period"])
    hist = av.expression(f"{name}_h", F.col(line) - F.col(sig), [line, sig])
    return {f"{name}_macd": line, f"{name}_signal": sig, name: hist}


def _stochastic(av: Averages, name: str, p: dict) -> dict[str, str]:
    n = p["fastK_period"]
    hi, lo = av.want("MAX", "high", n), av.want("MIN", "low", n)
    fast = av.expression(f"{name}_fast", F.when(F.col(hi) - F.col(lo) == 0, 0.0).otherwise(
        (F.col("close") - F.col(lo)) / (F.col(hi) - F.col(lo)) * 100.0), [hi, lo])
    k = fast if p["slowK_period"] == 1 else av.want(p["slowK_ma_type"], fast, p["slowK_period"])
    d = av.want(p["slowD_ma_type"], k, p["slowD_period"])
    spread = av.expression(f"{name}_kd", F.col(k) - F.col(d), [k, d])
    return {f"{name}_k": k, f"{name}_d": d, name: spread}


BUILDERS = {"ADX": _adx, "BollingerBands": _bollinger, "KeltnerChannel": _keltner, "ChaikinOsc": _chaikin,
            "MACD": _macd, "StochOsc": _stochastic}


def add_indicators(df: DataFrame, specs: list[tuple[str, str, dict]], layout: Layout = BARS,
                   parts: bool = False) -> DataFrame:
    """``(output, indicator, params)`` for any number of fitted indicators.

    All specs share one request table, so equal averages, ranges and extremes are
    computed once and each dependency level costs one pass.  ``parts`` also
    returns the component lines.
    """
    names = [n for n, _, _ in specs]
    if len(set(names)) != len(names):
        raise ValueError("duplicate indicator outputs")
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"outputs already present: {sorted(clash)}")
    used = {i for _, i, _ in specs}
    work = index_rows(df, layout)
    if used & {"ADX", "KeltnerChannel"}:
        work = with_ranges(work, layout)
    if "ChaikinOsc" in used:
        work = with_accumulation(work, layout)
    sources = {str(v) for _, _, p in specs for k, v in p.items() if k.endswith("source")}
    work = work.withColumns({f"_src_{s}": price_source(s, df) for s in sources}) if sources else work
    av = Averages(work, layout, leads={"tr": 1})
    outs: dict[str, str] = {}
    for name, indicator, params in specs:
        made = BUILDERS[indicator](av, name, params)
        main = {name: made.get(name, made.get(f"{name}_adx"))}
        outs.update({**main, **made} if parts else main)
    built = av.build()
    return built.select(*df.columns, *[F.col(c).alias(n) for n, c in outs.items()])


def first_difference(df: DataFrame, cols: list[str], layout: Layout = BARS) -> DataFrame:
    d = lagged(df, {f"_d_{c}": (c, 1) for c in cols}, layout)
    return d.withColumns({f"{c}_diff": F.col(c) - F.col(f"_d_{c}") for c in cols}).drop(*[f"_d_{c}" for c in cols])


def last_rows(df: DataFrame, n: int, layout: Layout = BARS) -> DataFrame:
    """The newest ``n`` rows of each series."""
    d = index_rows(df, layout)
    top = d.groupBy(*layout.key).agg(F.max("_i").alias("_top"))
    return d.join(top, list(layout.key)).where(F.col("_i") > F.col("_top") - n).drop("_top", "_i")


def latest_indicator(df: DataFrame, specs: list[tuple[str, str, dict]], window: int, layout: Layout = BARS) -> DataFrame:
    """Latest value of each indicator computed from the last ``window`` bars only."""
    tail = add_indicators(last_rows(df, window, layout), specs, layout)
    return tail.groupBy(*layout.key).agg(F.max(layout.time).alias(layout.time),
                                         *[F.max_by(n, layout.time).alias(n) for n, _, _ in specs])


# Extra bars asked of an indicator beyond its longest period.
HISTORY_PAD = 50
MARGIN_RATIO = 0.1
MIN_EXTRA = 50


def history_need(specs: DataFrame, ratio: float = MARGIN_RATIO, min_extra: int = MIN_EXTRA) -> DataFrame:
    """Bars of history each spec needs; ``params`` is a ``map<string,string>``."""
    periods = F.filter(F.transform(F.map_entries("params"), lambda e: F.when(
        F.lower(e["key"]).contains("period"), e["value"].try_cast("int"))), lambda v: v.isNotNull())
    longest = F.coalesce(F.array_max(periods), F.lit(0))

    def param(name, default):
        return F.coalesce(F.try_element_at("params", F.lit(name)).try_cast("int"), default)

    macd = F.greatest(longest, param("slow_period", longest) + param("signal_period", F.lit(0)) + HISTORY_PAD)
    padded = F.col("indicator").isin("ADX", "BollingerBands", "KeltnerChannel", "StochOsc")
    need = F.when(longest == 0, 0).when(F.col("indicator") == "MACD", macd).when(padded, longest + HISTORY_PAD).otherwise(longest)
    out = specs.withColumn("required", need.cast("int"))
    extra = F.greatest(F.lit(min_extra), F.ceil(F.col("required") * F.lit(ratio)))
    return out.withColumn("with_margin", F.when(F.col("required") <= 0, 0).otherwise(F.col("required") + extra).cast("int"))


