"""One-way diagnostics of a model: groups, grids, partial dependence, curve shape and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import attach_row
from barloom.operators.ordered import settle
from barloom.operators.quantiles import bucketed, quantile_columns

TIE_DIGITS = 10


def recent_rows(df: DataFrame, days: int, decision: Column | None = None, time: str = "ts") -> DataFrame:
    top = df.agg(F.max(time).alias("_hi"))
    d = attach_row(df, top).where(F.unix_seconds(time) >= F.unix_seconds("_hi") - days * 86_400).drop("_hi")
    return d if decision is None else d.where(decision)


def uniform_sample(indexed: DataFrame, rows: int, idx: str = "row_idx") -> DataFrame:
    """Evenly spaced positions over all rows."""
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    d = attach_row(indexed, n)
    i = F.col(idx)
    pick = (F.col("_n") <= rows) | (F.floor((i + 1) * rows / F.col("_n")) > F.floor(i * rows / F.col("_n")))
    return d.where(pick).drop("_n")


def seeded_sample(df: DataFrame, rows: int, seed: int, ids: list[str]) -> DataFrame:
    return df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids).limit(rows)


def distinct_counts(df: DataFrame, features: list[str], pred: str, target: str, weight: str) -> DataFrame:
    """Everything a group needs, per distinct value; hot values combine map-side."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    d = df.select(pred, target, weight, F.inline(cells)).where("value IS NOT NULL")
    w = F.col(weight)
    return d.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("w"), F.sum(w * F.col("value")).alias("wx"),
                                             F.sum(w * F.col(pred)).alias("wp"), F.sum(w * F.col(target)).alias("wy"))


def _cumulative(counts: DataFrame) -> DataFrame:
    """Rows at or below each distinct value of a feature, as a scan inside value buckets on top of bucket totals."""
    b = bucketed(counts, ["feature"], "value")
    ids = ["feature", "_bucket"]
    sizes = b.groupBy(*ids).agg(F.sum("rows").alias("_size"))
    before = Window.partitionBy("feature").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a feature
    sizes = sizes.select(*ids, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*ids).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return b.join(sizes, ids).select("feature", "value", "rows", (F.col("_before") + F.sum("rows").over(inside)).alias("upto"))


def _merge_small(groups: list[list], min_rows: int) -> list[list]:
    """``[left edge, right edge, rows]`` groups, small ones joined to the neighbour that is nearer in value."""
    i = 0
    while len(groups) > 1 and i < len(groups):
        left, right, rows = groups[i]
        if rows >= min_rows:
            i += 1
            continue
        down = left - groups[i - 1][1] if i else np.inf
        up = groups[i + 1][0] - right if i + 1 < len(groups) else np.inf
        lo = i - 1 if down <= up else i
        groups[lo:lo + 2] = [[groups[lo][0], groups[lo + 1][1], groups[lo][2] + groups[lo + 1][2]]]
        i = 0
    return groups


def bin_edges(counts: DataFrame, bins: int, min_rows: int) -> DataFrame:
    """Tie-aware equal-count groups: equal values never split, each cut goes to the count closest to its target size.

    Exact for any number of distinct values: a cut is a lookup in the cumulative counts, for all features at once, so
    there are ``bins`` small aggregates whatever the rows.
    """
    sums = settle(_cumulative(counts))
    spark = counts.sparkSession
    total = {r["feature"]: r["n"] for r in sums.groupBy("feature").agg(F.max("upto").alias("n")).collect()}     # features
    done = {f: 0 for f in total}
    groups: dict[str, list[list]] = {f: [] for f in total}
    for g in range(bins):
        open_ = [(f, n, float(n + (total[f] - n) / (bins - g)) if g < bins - 1 else float(total[f])) for f, n in done.items() if n < total[f]]
        if not open_:
            break
        d = sums.join(F.broadcast(spark.createDataFrame(open_, "feature string, _done bigint, _aim double")), "feature").where("upto > _done")
        near = d.groupBy("feature").agg(F.min("value").alias("left"), F.max("_done").alias("done"), F.max("_aim").alias("aim"),
                                        F.min(F.when(F.col("upto") >= F.col("_aim"), F.struct("upto", "value"))).alias("over"),
                                        F.max(F.when(F.col("upto") < F.col("_aim"), F.struct("upto", "value"))).alias("under"))
        for r in near.collect():                                                                               # features
            over, under, aim = r["over"], r["under"], r["aim"]
            end = under if over is None or under and abs(over["upto"] - aim) > abs(under["upto"] - aim) else over
            groups[r["feature"]].append([r["left"], end["value"], end["upto"] - r["done"]])
            done[r["feature"]] = end["upto"]
    rows = [(f, i, float(a), float(b)) for f in sorted(groups) for i, (a, b, _) in enumerate(_merge_small(groups[f], min_rows))]
    return spark.createDataFrame(rows, "feature string, bin int, left_edge double, right_edge double")


def tied(rate: str) -> Column:
    """A rate for comparisons: what differs by the order of summation alone is a tie."""
    return F.round(rate, TIE_DIGITS)


def observed_bins(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows, weight, weighted centre, mean prediction and target rate per bin."""
    e = edges.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("right_edge", "bin", "left_edge"))).alias("_e"))  # a few bins
    d = counts.join(e, "feature").withColumn("_b", F.element_at(F.filter("_e", lambda x: x["right_edge"] >= F.col("value")), 1))
    a = d.groupBy("feature", F.col("_b.bin").alias("bin")).agg(F.min("value").alias("left_edge"), F.max("value").alias("right_edge"), F.sum("rows").alias("rows"),
                                                               F.sum("w").alias("weight"), F.sum("wx").alias("wx"), F.sum("wp").alias("wp"), F.sum("wy").alias("wy"))
    return a.select("feature", "bin", "left_edge", "right_edge", ((F.col("left_edge") + F.col("right_edge")) / 2).alias("center"), "rows", "weight",
                    (F.col("wx") / F.col("weight")).alias("mean_value"), (F.col("wp") / F.col("weight")).alias("pred_mean"),
                    (F.col("wy") / F.col("weight")).alias("target_rate"))


def equal_count_groups(ranked: DataFrame, groups: int, idx: str, total: str) -> DataFrame:
    """Plain equal-count groups of sorted rows: the first ``n mod k`` groups hold one more row."""
    i, n, k = F.col(idx), F.col(total), F.lit(groups)
    big, small = F.floor(n / k) + 1, F.floor(n / k)
    rest = n % k
    return ranked.withColumn("group", F.when(i < rest * big, F.floor(i / big)).otherwise(
        rest + F.floor((i - rest * big) / F.greatest(small, F.lit(1)))).cast("int"))


def grid_points(groups: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Distinct medians of the groups."""
    m = quantile_columns(groups, [*keys, "group"], value, {"grid": 0.5})
    return m.select(*keys, "grid").distinct()


def bin_summary(bins: DataFrame) -> DataFrame:
    return bins.groupBy("feature").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("rows").alias("rows"),
        *[f(F.col("center"), F.struct(tied(c), F.col("bin"))).alias(n) for n, f, c in (
            ("min_pred_at", F.min_by, "pred_mean"), ("max_pred_at", F.max_by, "pred_mean"), ("min_target_at", F.min_by, "target_rate"),
            ("max_target_at", F.max_by, "target_rate"))],
        (F.max("pred_mean") - F.min("pred_mean")).alias("pred_range"), (F.max("target_rate") - F.min("target_rate")).alias("target_range"))


def partial_dependence(rows: DataFrame, grid: DataFrame, features: list[str], score, weight: str) -> DataFrame:
    """Weighted mean prediction with one feature set to each grid value.

    Every row is scored once per (feature, grid value); the grid has a few
    values per feature and is attached as an array per job, not joined by key.
    """
    table = grid.agg(F.collect_list(F.struct("feature", "grid")).alias("_g"))  # features x grid points
    d = attach_row(rows, table).select("*", F.inline("_g")).drop("_g")
    d = d.withColumns({f: F.when(F.col("feature") == f, F.col("grid")).otherwise(F.col(f)) for f in features})
    s = score(d)
    return s.groupBy("feature", "grid").agg((F.sum(F.col("p") * F.col(weight)) / F.sum(weight)).alias("pd"))


def curve_class(curve: DataFrame, keys: list[str], x: str, y: str, flat: float = 1e-6, mostly: float = 0.8) -> DataFrame:
    """Shape of a curve of a few points: flat, mostly increasing/decreasing, inverted_u, u_shape or mixed."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = curve.withColumn(y, tied(y)).withColumns({"_d": F.col(y) - F.lag(y).over(w), "_k": F.row_number().over(w)})
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(y) - F.min(y)).alias("range"), F.count_if(F.col("_d") > 0).alias("up"),
                             F.count_if(F.col("_d") < 0).alias("down"), F.max_by("_k", F.struct(F.col(y), -F.col("_k"))).alias("_top"),
                             F.min_by("_k", F.struct(F.col(y), F.col("_k"))).alias("_low"))
    moves = F.greatest(F.col("up") + F.col("down"), F.lit(1))
    inner = lambda c: (F.col(c) > 1) & (F.col(c) < F.col("n"))
    shape = (F.when(F.col("range") <= flat, "flat").when(F.col("up") / moves >= mostly, "mostly_increasing")
             .when(F.col("down") / moves >= mostly, "mostly_decreasing").when(inner("_top") & ~inner("_low"), "inverted_u")
             .when(inner("_low") & ~inner("_top"), "u_shape").otherwise("mixed"))
    return a.withColumn("shape", shape).drop("_top", "_low")


def scaled_slope(curve: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted slope on x scaled to [0, 1]."""
    b = curve.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    d = curve.join(b, keys).withColumn("_x", F.when(F.col("_hi") > F.col("_lo"), (F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    W = F.col(w)
    s = d.groupBy(*keys).agg(F.sum(W).alias("s"), F.sum(W * F.col("_x")).alias("sx"), F.sum(W * F.col(y)).alias("sy"),
                             F.sum(W * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(W * F.col("_x") * F.col(y)).alias("sxy"))
    den = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    return s.select(*keys, F.when(den != 0, (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).alias("slope"))


def kendall_tau(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Tau-b with ties over the bins of a curve (a handful of rows per key); rates equal to ``TIE_DIGITS`` digits tie."""
    pts = curve.groupBy(*keys).agg(F.collect_list(F.struct(tied(x).alias("x"), tied(y).alias("y"))).alias("_p"))  # bins only
    sgn = lambda a, b: F.signum(a - b)
    d = pts.select(*keys, F.posexplode("_p").alias("_i", "_a"), "_p")
    cells = F.transform(F.filter(F.transform("_p", lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda q: q["i"] > F.col("_i")),
                        lambda q: F.struct(sgn(q["b"]["x"], F.col("_a.x")).alias("sx"), sgn(q["b"]["y"], F.col("_a.y")).alias("sy")))
    e = d.select(*keys, F.inline(cells)).groupBy(*keys).agg(
        F.sum(F.col("sx") * F.col("sy")).alias("c"), F.count_if(F.col("sx") != 0).alias("nx"), F.count_if(F.col("sy") != 0).alias("ny"))
    return e.select(*keys, F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("c") / F.sqrt((F.col("nx") * F.col("ny")).cast("double"))).alias("tau"))


def local_regression(curve: DataFrame, keys: list[str], x: str, y: str, w: str, span: float = 0.6) -> DataFrame:
    """Tricube-weighted local line through the nearest share of the bins, with a 95% band."""
    pts = curve.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).alias("w"))).alias("_p"))  # bins only
    d = pts.select(*keys, F.explode("_p").alias("_a"), "_p").withColumn("x0", F.col("_a.x"))
    k = F.greatest(F.ceil(F.size("_p") * span).cast("int"), F.lit(2))
    dist = F.array_sort(F.transform("_p", lambda b: F.abs(b["x"] - F.col("x0"))))
    d = d.withColumn("_h", F.greatest(F.try_element_at(dist, F.least(k, F.size("_p"))), F.lit(1e-12)))
    cells = F.transform("_p", lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), (b["w"] * F.pow(
        F.greatest(1 - F.pow(F.abs(b["x"] - F.col("x0")) / F.col("_h"), F.lit(3)), F.lit(0.0)), F.lit(3))).alias("u")))
    e = d.select(*keys, "x0", F.inline(cells)).where("u > 0").withColumn("dx", F.col("x") - F.col("x0"))
    U = F.col("u")
    a = e.groupBy(*keys, "x0").agg(F.sum(U).alias("s"), F.sum(U * F.col("dx")).alias("sx"), F.sum(U * F.col("y")).alias("sy"),
                                   F.sum(U * F.col("dx") * F.col("dx")).alias("sxx"), F.sum(U * F.col("dx") * F.col("y")).alias("sxy"),
                                   F.sum(U * F.col("y") * F.col("y")).alias("syy"), F.sum(U * U).alias("suu"))
    den = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    line = F.abs(den) > 1e-12
    b1 = F.when(line, (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).otherwise(0.0)
    b0 = F.when(line, (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / den).otherwise(F.col("sy") / F.col("s"))
    a = a.withColumns({"fit": b0, "_b1": b1})
    var = F.greatest(F.col("syy") / F.col("s") - 2 * (F.col("fit") * F.col("sy") + F.col("_b1") * F.col("sxy")) / F.col("s")
                     + F.pow("fit", F.lit(2)) + 2 * F.col("fit") * F.col("_b1") * F.col("sx") / F.col("s") + F.pow("_b1", F.lit(2)) * F.col("sxx") / F.col("s"), F.lit(0.0))
    half = F.lit(1.96) * F.sqrt(var * F.col("suu")) / F.col("s")
    return a.select(*keys, F.col("x0").alias(x), "fit", (F.col("fit") - half).alias("lower"), (F.col("fit") + half).alias("upper"))


def alignment(bins: DataFrame, curve: DataFrame) -> DataFrame:
    """Weighted distance of prediction, and of the interpolated dependence curve, from the target rate per feature."""
    g = curve.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("grid", "pd"))).alias("_g"))  # grid points only
    d = bins.join(g, "feature")
    x = F.least(F.greatest(F.col("mean_value"), F.element_at("_g", 1)["grid"]), F.element_at("_g", -1)["grid"])
    d = d.withColumn("_x", x)
    d = d.withColumns({"_lo": F.element_at(F.filter("_g", lambda p: p["grid"] <= F.col("_x")), -1), "_hi": F.element_at(F.filter("_g", lambda p: p["grid"] >= F.col("_x")), 1)})
    step = F.col("_hi.grid") - F.col("_lo.grid")
    d = d.withColumn("pd_at", F.when(step == 0, F.col("_lo.pd")).otherwise(F.col("_lo.pd") + (F.col("_hi.pd") - F.col("_lo.pd")) * (F.col("_x") - F.col("_lo.grid")) / step))
    W = F.col("weight")
    return d.groupBy("feature").agg((F.sum(W * F.abs(F.col("pred_mean") - F.col("target_rate"))) / F.sum(W)).alias("pred_mae"),
                                    (F.sum(W * F.abs(F.col("pd_at") - F.col("target_rate"))) / F.sum(W)).alias("pd_mae"))


def suspicion(stats: DataFrame, strong: float = 0.5, weak: float = 0.2) -> DataFrame:
    """Category and action per feature from the direction of dependence and observed target rate.

    A NULL direction is insufficient; NaN has no sign and is above every bound.
    """
    a, b = F.col("pd_tau"), F.col("target_tau")
    opposite = (F.signum(a) * F.signum(b) < 0) & (F.abs(a) >= strong) & (F.abs(b) >= strong)
    cat = (F.when(a.isNull() | b.isNull(), "insufficient").when(opposite, "direction_conflict").when((F.abs(a) >= strong) & (F.abs(b) < weak), "model_only")
           .when((F.abs(a) < weak) & (F.abs(b) >= strong), "target_only").otherwise("aligned"))
    score = F.when(cat == "direction_conflict", 3).when(cat == "model_only", 2).when(cat == "target_only", 1).otherwise(0)
    act = F.when(score == 3, "review").when(score > 0, "watch").otherwise("keep")
    return stats.withColumns({"category": cat, "action": act, "suspicion": score}).orderBy(F.col("suspicion").desc(), F.col("pred_mae").desc(), "feature")
