"""Dedup, dense calendars, frozen blocks, gap repair and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import all_of, epoch, shift
from barloom.operators.ordered import BARS, Layout, lagged, run_bounds, running, settle

OHLC = ("open", "high", "low", "close")
OHLCV = (*OHLC, "volume")
INSERTED_VOLUME = -1.0  # fixed marker of a row that was not in the source


def keep_last(df: DataFrame, key: tuple[str, ...], order: Column) -> DataFrame:
    """Last row per key as an aggregate: duplicates collapse map-side and no key is sorted in one task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(
        *key, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def coerce_numeric(df: DataFrame, cols=OHLCV, header: tuple[str, ...] = ("open", "high", "low", "close", "volume", "opened")) -> DataFrame:
    """Header echoes dropped, text to number or NULL, rows without a full price dropped."""
    echo = F.greatest(*[F.lower(F.trim(F.col(c).cast("string"))).isin(*header) for c in cols])
    out = df.where(~F.coalesce(echo, F.lit(False))).withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})
    return out.dropna(subset=[c for c in cols if c in OHLC])


def price_volume_hybrid(price: DataFrame, volume: DataFrame, prefix: str, key: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Prices from one source, volume and renamed auxiliary prices from the other, matched on open time."""
    aux = volume.select(*key, "volume", *[F.col(c).alias(f"{prefix}_{c}") for c in OHLC])
    return price.select(*key, *OHLC).join(aux, list(key), "inner")


def align_columns(df: DataFrame, source: DataFrame, cols: list[str], key: tuple[str, ...] = ("symbol", "ts"),
                  strict: bool = True) -> DataFrame:
    """Source columns by open time; a row without a match fails the job when ``strict``."""
    right = source.select(*key, *cols, F.lit(1).alias("_hit"))
    out = df.join(right, list(key), "left")
    if strict:
        out = out.where(F.when(F.col("_hit") == 1, True).otherwise(
            F.raise_error(F.lit("row without auxiliary source")).cast("boolean")))
    return out.drop("_hit")


def missing_ranges(bars: DataFrame, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    """Ranges of absent bars: first and last missing open time between two present neighbours."""
    d = lagged(bars.select(*layout.key, layout.time), {"_prev": (layout.time, 1)}, layout)
    step = epoch(layout.time) - epoch("_prev")
    return d.where(step > base_seconds).select(
        *layout.key, shift("_prev", base_seconds).alias("from_ts"), shift(layout.time, -base_seconds).alias("to_ts"),
        (step / base_seconds - 1).cast("bigint").alias("missing"))


def missing_times(bars: DataFrame, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    """One row per absent bar.  A long gap is cut into spans first, so it expands in many tasks."""
    gaps = missing_ranges(bars, base_seconds, layout)
    span = F.lit(layout.span_seconds)
    parts = gaps.withColumn("_s", F.explode(F.sequence(F.floor(epoch("from_ts") / span), F.floor(epoch("to_ts") / span))))
    lo = F.greatest(epoch("from_ts"), F.ceil((F.col("_s") * span - epoch("from_ts")) / base_seconds) * base_seconds + epoch("from_ts"))
    hi = F.least(epoch("to_ts"), (F.col("_s") + 1) * span - 1)
    times = parts.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").repartition(*layout.key, "_s")
    return times.select(*layout.key, F.explode(F.sequence("_lo", "_hi", F.lit(base_seconds).cast("bigint"))).alias("_e")).select(
        *layout.key, F.timestamp_seconds("_e").alias(layout.time))


def dense_reindex(bars: DataFrame, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    """Every open time between first and last bar; new rows carry the last prices and a marker volume."""
    present = bars.select(*layout.key, layout.time, *OHLCV)
    full = present.unionByName(missing_times(bars, base_seconds, layout), allowMissingColumns=True)
    inserted = F.greatest(*[F.col(c).isNull() for c in OHLC])
    flagged = full.withColumn("inserted", inserted)
    filled = running(flagged, layout, **{f"_f_{c}": ("last", F.col(c)) for c in OHLC})
    return filled.select(*layout.key, layout.time, *[F.col(f"_f_{c}").alias(c) for c in OHLC],
                         F.when(F.col("inserted"), INSERTED_VOLUME).otherwise(F.col("volume")).alias("volume"), "inserted")


def _same_as_previous(df: DataFrame, cols, layout: Layout) -> DataFrame:
    prev = lagged(df, {f"_p_{c}": (c, 1) for c in cols}, layout)
    same = F.coalesce(all_of([F.col(c) == F.col(f"_p_{c}") for c in cols]), F.lit(False))
    return prev.withColumn("_same", same).drop(*[f"_p_{c}" for c in cols])


def gap_blocks(bars: DataFrame, min_len: int, layout: Layout = BARS) -> DataFrame:
    """Rows of runs of equal OHLCV with at least ``min_len`` rows (first row counted).

    Adds ``gap`` and the bounds ``block_start`` / ``block_end`` of the contiguous gap rows.
    """
    runs = run_bounds(_same_as_previous(bars, OHLCV, layout), ~F.col("_same"), layout)
    size = F.col("run_end") - F.col("run_start") + 1
    flagged = settle(runs.withColumn("gap", size >= min_len).drop("run_start", "run_end", "_same"))
    edge = lagged(flagged, {"_pg": ("gap", 1)}, layout)
    blocks = run_bounds(edge, F.col("_pg").isNull() | (F.col("_pg") != F.col("gap")), layout)
    return blocks.withColumns({"block_start": F.when(F.col("gap"), F.col("run_start")),
                               "block_end": F.when(F.col("gap"), F.col("run_end"))}).drop("run_start", "run_end", "_pg")


def frozen_flags(bars: DataFrame, min_len: int, layout: Layout = BARS) -> DataFrame:
    """``frozen`` marks rows equal to the previous row on OHLC when the run repeats at least ``min_len`` times."""
    runs = run_bounds(_same_as_previous(bars, OHLC, layout), ~F.col("_same"), layout)
    repeats = F.col("run_end") - F.col("run_start")
    return runs.withColumns({"repeats": repeats, "frozen": F.col("_same") & (repeats >= min_len),
                             "block_head": F.col("_same") & (repeats >= min_len) & (F.col("_i") == F.col("run_start") + 1)}).drop(
        "_same", "run_start", "run_end")


def drop_frozen(bars: DataFrame, min_len: int = 3, layout: Layout = BARS) -> DataFrame:
    return frozen_flags(bars, min_len, layout).where(~F.col("frozen")).drop("frozen", "repeats", "block_head", "_i")


def frozen_summary(bars: DataFrame, min_len: int = 3, layout: Layout = BARS) -> DataFrame:
    f = frozen_flags(bars, min_len, layout)
    at = F.when(F.col("frozen"), F.col(layout.time))
    return f.groupBy(*layout.key).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if("frozen").alias("rows_removed"),
        F.count_if("block_head").alias("blocks_removed"),
        F.coalesce(F.max(F.when(F.col("frozen"), F.col("repeats"))), F.lit(0)).alias("largest_block_len"),
        F.min(at).alias("first_removed"), F.max(at).alias("last_removed"))


# ---- repair ----------------------------------------------------------------------------------

def wick_observations(bars: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Long ``(key, kind, x)`` rows: body return and wicks split by candle direction."""
    o, h, lo, c = (F.col(x) for x in OHLC)
    side = F.when(c >= o, "bull").otherwise("bear")
    rows = F.array(
        F.struct(F.lit("returns").alias("kind"), (c - o).alias("x")),
        F.struct(F.concat(F.lit("high_"), side).alias("kind"), F.greatest(h - F.greatest(o, c), F.lit(0.0)).alias("x")),
        F.struct(F.concat(F.lit("low_"), side).alias("kind"), F.greatest(F.least(o, c) - lo, F.lit(0.0)).alias("x")))
    return bars.select(*key, F.inline(rows))


def fit_histograms(obs: DataFrame, bins: int, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Equal-width histogram per ``(key, kind)``; empty bins dropped; probabilities and running probability."""
    ids = [*key, "kind"]
    edges = obs.groupBy(*ids).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((F.col("x") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    counted = obs.join(edges, ids).withColumn("bin", slot).groupBy(*ids, "bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("rows"))
    left = F.col("_lo") + F.col("bin") * width
    right = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("bin") + 1) * width)
    sized = counted.select(*ids, "bin", left.alias("left"), right.alias("right"), "rows", (F.col("rows") / F.col("_n")).alias("prob"))
    upto = Window.partitionBy(*ids).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    return sized.withColumn("cum", F.sum("prob").over(upto))


def sampler_table(hist: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per key: kind -> sorted bins; size bounded by kinds times bins."""
    per = hist.groupBy(*key, "kind").agg(F.array_sort(F.collect_list(F.struct("cum", "left", "right"))).alias("bins"))
    return per.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("kind", "bins"))).alias("samplers"))


def uniform(*parts) -> Column:
    """Deterministic number in [0, 1) from row identity, so a re-run task draws the same value."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def draw(kind: Column, identity: list, seed: int, label: str) -> Column:
    """Bin by probability, then uniform inside the bin; a one-value column returns that value."""
    bins = F.try_element_at("samplers", kind)
    u, v = uniform(*identity, F.lit(seed), F.lit(label)), uniform(*identity, F.lit(seed), F.lit(label + "/inside"))
    hit = F.filter(bins, lambda b: b["cum"] > u)
    pick = F.when(F.size(hit) > 0, hit[0]).otherwise(F.element_at(bins, -1))
    return pick["left"] + (pick["right"] - pick["left"]) * v


def block_anchors(flagged: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Per gap block: rows, bounds, close before it and open after it (NULL at the end of the series)."""
    d = lagged(flagged, {"_pc": ("close", 1), "_no": ("open", -1)}, layout)
    at_start, at_end = F.col("_i") == F.col("block_start"), F.col("_i") == F.col("block_end")
    return d.where("gap").groupBy(*layout.key, "block_start", "block_end").agg(
        F.count(F.lit(1)).alias("rows"), F.min(layout.time).alias("start_ts"), F.max(layout.time).alias("end_ts"),
        F.max(F.when(at_start, F.coalesce("_pc", "open"))).alias("left_anchor"),
        F.max(F.when(at_end, F.col("_no"))).alias("right_anchor"))


def bridge_returns(rows: DataFrame, raw: str, power: float, layout: Layout = BARS) -> DataFrame:
    """Adjust raw returns of each block so they sum to right anchor minus left anchor.

    Row ``k`` of a block takes a share proportional to ``k^power``.  Sums run as block
    aggregates that combine map-side, so one block may be arbitrarily long.
    """
    k = (F.col("_i") - F.col("block_start") + 1).cast("double")
    w = rows.withColumn("_w", F.pow(k, F.lit(power)))
    ids = [*layout.key, "block_start"]
    sums = w.groupBy(*ids).agg(F.sum(raw).alias("_raw_sum"), F.sum("_w").alias("_w_sum"))
    target = F.col("right_anchor") - F.col("left_anchor")
    corr = F.when(F.col("right_anchor").isNull(), 0.0).otherwise(target - F.col("_raw_sum"))
    return (w.join(sums, ids).withColumn("correction_total", corr)
            .withColumn("adjusted", F.col(raw) + F.col("_w") / F.col("_w_sum") * corr)
            .withColumnRenamed("_raw_sum", "raw_return_sum").drop("_w", "_w_sum"))


def repair_gap_prices(flagged: DataFrame, samplers: DataFrame, power: float = 1.0, seed: int = 0,
                      layout: Layout = BARS) -> DataFrame:
    """Simulated prices inside gap blocks: open = previous close, close = open + bridged return, drawn wicks."""
    ids = [*layout.key, layout.time]
    anchors = block_anchors(flagged, layout).drop("start_ts", "end_ts", "rows")
    g = (flagged.where("gap").join(anchors, [*layout.key, "block_start", "block_end"])
         .join(samplers, list(layout.key)).withColumn("_raw", draw(F.lit("returns"), ids, seed, "return")))
    g = settle(bridge_returns(g, "_raw", power, layout))
    # Running sum over the whole series' gap rows; subtracting its value before the block gives the path.
    path = settle(running(g, layout, _cum=("sum", F.col("adjusted"))))
    before = path.where(F.col("_i") == F.col("block_start")).select(
        *layout.key, "block_start", (F.col("_cum") - F.col("adjusted")).alias("_base"))
    p = path.join(before, [*layout.key, "block_start"])
    close = F.col("left_anchor") + F.col("_cum") - F.col("_base")
    p = p.withColumn("_close", close).withColumn("_open", F.col("_close") - F.col("adjusted"))
    side = F.when(F.col("_close") >= F.col("_open"), "bull").otherwise("bear")
    up = F.coalesce(draw(F.concat(F.lit("high_"), side), ids, seed, "high"), F.lit(0.0))
    down = F.coalesce(draw(F.concat(F.lit("low_"), side), ids, seed, "low"), F.lit(0.0))
    fixed = p.select(*layout.key, "_i", F.col("_open").alias("r_open"),
                     (F.greatest("_open", "_close") + F.greatest(up, F.lit(0.0))).alias("r_high"),
                     (F.least("_open", "_close") - F.greatest(down, F.lit(0.0))).alias("r_low"),
                     F.col("_close").alias("r_close"), "adjusted", "raw_return_sum", "correction_total")
    joined = flagged.join(fixed, [*layout.key, "_i"], "left")
    return joined.withColumns({**{c: F.when(F.col("gap"), F.col(f"r_{c}")).otherwise(F.col(c)) for c in OHLC},
                               "volume": F.when(F.col("gap"), F.lit(None).cast("double")).otherwise(F.col("volume"))}).drop(
        *[f"r_{c}" for c in OHLC])


def volume_by_range(rows: DataFrame, bins: int, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean volume per equal-width candle-range bin of the rows marked ``valid``; populated bins only."""
    valid = rows.where("valid").withColumn("_r", F.col("high") - F.col("low"))
    edges = valid.groupBy(*key).agg(F.min("_r").alias("r_lo"), F.max("_r").alias("r_hi"), F.avg("volume").alias("mean_all"))
    slot = range_slot(F.col("_r"), bins)
    return valid.join(edges, list(key)).withColumn("bin", slot).groupBy(*key, "r_lo", "r_hi", "mean_all", "bin").agg(
        F.avg("volume").alias("mean_volume"), F.count(F.lit(1)).alias("rows"))


def range_slot(r: Column, bins: int) -> Column:
    raw = F.floor((r - F.col("r_lo")) / ((F.col("r_hi") - F.col("r_lo")) / bins))
    return F.when(F.col("r_hi") == F.col("r_lo"), 0).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).cast("int")


def fill_volume(rows: DataFrame, bins: int, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Volume of rows marked ``invalid`` from the mean of their range bin, else of the nearest populated bin."""
    r = F.col("high") - F.col("low")
    marked = rows.withColumn("valid", ~F.col("invalid") & (r >= 0) & (F.col("volume") > 0))
    table = volume_by_range(marked, bins, key).groupBy(*key, "r_lo", "r_hi", "mean_all").agg(
        F.array_sort(F.collect_list(F.struct("bin", "mean_volume"))).alias("_bins"))  # at most ``bins`` entries
    j = marked.join(table, list(key), "left").withColumn("_slot", range_slot(r, bins))
    near = F.array_min(F.transform("_bins", lambda b: F.struct(F.abs(b["bin"] - F.col("_slot")).alias("gap"), b["bin"].alias("bin"),
                                                              b["mean_volume"].alias("mean"))))
    value = F.when(F.col("r_hi") == F.col("r_lo"), F.col("mean_all")).otherwise(near["mean"])
    fill = F.col("invalid") & (r >= 0) & F.col("_bins").isNotNull()
    return j.withColumns({"volume_filled": fill, "volume_fallback": fill & (near["gap"] > 0) & (F.col("r_hi") != F.col("r_lo")),
                          "volume": F.when(fill, value).otherwise(F.col("volume"))}).drop(
        "_bins", "_slot", "r_lo", "r_hi", "mean_all")


def round_bars(df: DataFrame, price_decimals: int | None, volume_decimals: int | None) -> DataFrame:
    """Half-even rounding with a flag for rows that changed."""
    new = {c: F.bround(c, price_decimals) for c in OHLC} if price_decimals is not None else {}
    if volume_decimals is not None:
        new["volume"] = F.bround("volume", volume_decimals)
    if not new:
        return df.withColumn("rounded", F.lit(False))
    changed = F.greatest(F.lit(False), *[~F.col(c).eqNullSafe(v) for c, v in new.items()])
    return df.withColumn("rounded", changed).withColumns(new)


def repair(bars: DataFrame, base_seconds: int, *, min_len: int = 3, bins: int = 50, range_bins: int = 20, power: float = 1.0,
           seed: int = 0, price_decimals: int | None = None, volume_decimals: int | None = None,
           layout: Layout = BARS) -> DataFrame:
    """Dense calendar, simulated prices in frozen blocks, volume by candle range, rounding; flags kept per row."""
    dense = settle(dense_reindex(bars, base_seconds, layout))
    flagged = settle(gap_blocks(dense, min_len, layout))
    hist = fit_histograms(wick_observations(flagged.where(~F.col("gap")), layout.key), bins, layout.key)
    priced = settle(repair_gap_prices(flagged, sampler_table(hist, layout.key), power, seed, layout))
    bad = F.coalesce(F.col("volume") <= 0, F.lit(True)) | F.col("inserted") | F.col("gap")
    filled = fill_volume(priced.withColumn("invalid", bad), range_bins, layout.key)
    return round_bars(filled, price_decimals, volume_decimals)


def repair_summary(repaired: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return repaired.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows_after"), F.count_if("inserted").alias("inserted"), F.count_if("gap").alias("gap_rows"),
        F.count_if(F.col("gap") & (F.col("_i") == F.col("block_start"))).alias("gap_blocks"),
        F.count_if("invalid").alias("invalid_volume"), F.count_if("volume_filled").alias("filled_volume"),
        F.count_if(F.col("invalid") & ~F.col("volume_filled")).alias("unresolved_volume"),
        F.count_if("volume_fallback").alias("volume_fallbacks"), F.count_if("rounded").alias("rounded_rows"))


def gap_context(flagged: DataFrame, rows: int, layout: Layout = BARS) -> DataFrame:
    """Gap rows and up to ``rows`` neighbours on each side, tagged with the block they belong to."""
    mark = F.when(F.col("gap"), F.struct("block_start", "_i"))
    d = running(flagged, layout, _left=("last", mark), _right=("last", mark, {"reverse": True}))
    inside = F.col("gap")
    after = (F.col("_i") - F.col("_left._i")) <= rows
    before = (F.col("_right._i") - F.col("_i")) <= rows
    near = F.array_compact(F.array(
        F.when(inside, F.struct(F.col("block_start").alias("block"), F.lit("gap").alias("place"))),
        F.when(~inside & after, F.struct(F.col("_left.block_start").alias("block"), F.lit("after").alias("place"))),
        F.when(~inside & before, F.struct(F.col("_right.block_start").alias("block"), F.lit("before").alias("place")))))
    return d.select(*layout.key, layout.time, "_i", *OHLC, F.inline(near))


def integrity_report(bars: DataFrame, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    d = lagged(bars.select(*layout.key, layout.time), {"_prev": (layout.time, 1)}, layout)
    return d.groupBy(*layout.key).agg(F.count(F.lit(1)).alias("rows"), F.min(layout.time).alias("oldest"), F.max(layout.time).alias("newest"),
                                      F.count_if(epoch(layout.time) - epoch("_prev") > base_seconds).alias("gaps"))


def base_interval(bars: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Most frequent step in seconds, the smaller one on a tie."""
    d = lagged(bars.select(*layout.key, layout.time), {"_prev": (layout.time, 1)}, layout)
    steps = d.where(F.col("_prev").isNotNull()).groupBy(*layout.key, (epoch(layout.time) - epoch("_prev")).alias("step")).agg(
        F.count(F.lit(1)).alias("n"))
    return steps.groupBy(*layout.key).agg(F.max_by("step", F.struct(F.col("n"), -F.col("step"))).alias("step"))


def compare_sources(left: DataFrame, right: DataFrame, cols, key: tuple[str, ...] = ("symbol", "ts"), atol: float = 1e-8,
                    rtol: float = 1e-6) -> DataFrame:
    """Largest absolute difference per column and whether all matched rows agree within tolerance."""
    j = left.select(*key, *cols).join(right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in cols]), list(key))
    diff = {c: F.abs(F.col(c) - F.col(f"_r_{c}")) for c in cols}
    close = all_of([F.coalesce(d <= atol + rtol * F.abs(F.col(f"_r_{c}")), F.col(c).isNull() & F.col(f"_r_{c}").isNull())
                    for c, d in diff.items()])
    return j.agg(F.count(F.lit(1)).alias("rows"), F.min(close.cast("int")).alias("is_match"),
                 *[F.max(d).alias(f"max_diff_{c}") for c, d in diff.items()],
                 F.max(F.greatest(*diff.values()) if len(diff) > 1 else next(iter(diff.values()))).alias("max_diff"))


def catch_up(bars: DataFrame, archive: DataFrame, base_seconds: int, layout: Layout = BARS) -> DataFrame:
    """Bars plus the archive rows that fill their missing open times."""
    need = missing_times(bars, base_seconds, layout)
    have = archive.join(need, [*layout.key, layout.time], "left_semi")
    return bars.withColumn("caught_up", F.lit(False)).unionByName(have.select(*bars.columns).withColumn("caught_up", F.lit(True)))

