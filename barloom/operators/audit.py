"""Parity audits: matrix comparison, rollups, drift reasons, stable windows, drop candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import any_of, finite
from barloom.operators.indicators import add_indicators
from barloom.operators.ordered import BARS, Layout, index_rows, settle


def long_form(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """``(ids, feature, value)`` with NaN and infinity as NULL."""
    d = df.select(*ids, *[finite(F.col(f).cast("double")).alias(f) for f in features])
    return d.unpivot(ids, features, "feature", "value")


def matrix_diff(candidate: DataFrame, reference: DataFrame, features: list[str], ids: list[str], rel_eps: float = 1e-12) -> DataFrame:
    """Absolute and relative difference per cell, and whether only one side has a value.

    Wide rows are matched on their ids first; cells are unpivoted after the join.
    """
    c = candidate.select(*ids, *[finite(F.col(f).cast("double")).alias(f"c_{f}") for f in features])
    r = reference.select(*ids, *[finite(F.col(f).cast("double")).alias(f"r_{f}") for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c_{f}").alias("candidate"), F.col(f"r_{f}").alias("reference")) for f in features])
    d = c.join(r, ids).select(*ids, F.inline(cells))
    diff = F.abs(F.col("candidate") - F.col("reference"))
    return d.withColumns({"abs_diff": diff, "rel_diff": diff / F.greatest(F.abs("reference"), F.lit(rel_eps)),
                          "status_mismatch": F.col("candidate").isNull() != F.col("reference").isNull()})


def diff_rollup(diff: DataFrame, keys: list[str], worst: str | None = None) -> DataFrame:
    """Mean, max, rmse and mismatch counts per key; ``worst`` names the column at the largest difference."""
    a, r = F.col("abs_diff"), F.col("rel_diff")
    aggs = [F.count(F.lit(1)).alias("cells"), F.count(a).alias("compared"), F.avg(a).alias("mean_abs"), F.max(a).alias("max_abs"),
            F.sqrt(F.avg(a * a)).alias("rmse"), F.avg(r).alias("mean_rel"), F.max(r).alias("max_rel"),
            F.count_if("status_mismatch").alias("status_mismatches")]
    if worst:
        aggs.append(F.max_by(worst, F.when(a.isNotNull(), F.struct(a, F.col(worst)))).alias("worst"))
    return diff.groupBy(*keys).agg(*aggs)


def frames_match(a: DataFrame, b: DataFrame, features: list[str], ids: list[str], atol: float = 1e-8, rtol: float = 1e-6) -> DataFrame:
    d = matrix_diff(a, b, features, ids)
    ok = F.coalesce(F.col("abs_diff") <= atol + rtol * F.abs("reference"), ~F.col("status_mismatch"))
    return d.agg(F.min(ok.cast("int")).alias("is_match"), F.max("abs_diff").alias("max_abs_diff"))


def grouped_rollup(diff: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rollup per group and per builder of each feature, in one pass over per-feature partials."""
    per = diff.groupBy("feature").agg(F.count("abs_diff").alias("n"), F.sum("abs_diff").alias("s"), F.max("abs_diff").alias("m"),
                                      F.count_if("status_mismatch").alias("x"))
    j = per.join(mapping, "feature", "left").fillna("unmapped", ["group", "builder"])
    rolled = j.groupingSets([["group"], ["builder"]], "group", "builder").agg(
        (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_abs"), F.max("m").alias("max_abs"), F.sum("x").alias("status_mismatches"),
        F.count(F.lit(1)).alias("features"))
    return rolled.select(F.when(F.col("group").isNotNull(), "group").otherwise("builder").alias("level"),
                         F.coalesce("group", "builder").alias("name"), "features", "mean_abs", "max_abs", "status_mismatches")


def decision_mismatches(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
    """Probability gap, signal flip, and disagreement in side, reason, trade or stake."""
    names = ["proba_up", "decision", "reason", "trade_side", "bet"]
    j = a.select(*ids, *names).join(b.select(*ids, *[F.col(n).alias(f"r_{n}") for n in names]), ids)
    return j.withColumns({
        "proba_gap": F.abs(F.col("proba_up") - F.col("r_proba_up")), "flip": (F.col("proba_up") >= 0.5) != (F.col("r_proba_up") >= 0.5),
        "side_mismatch": ~F.col("trade_side").eqNullSafe(F.col("r_trade_side")), "reason_mismatch": ~F.col("reason").eqNullSafe(F.col("r_reason")),
        "trade_mismatch": (F.col("decision") == "no_trade") != (F.col("r_decision") == "no_trade"),
        "stake_mismatch": F.abs(F.coalesce("bet", F.lit(0.0)) - F.coalesce("r_bet", F.lit(0.0))) > 1e-9})


def feature_impact(candidate: DataFrame, reference: DataFrame, features: list[str], ids: list[str], score) -> DataFrame:
    """Replace one feature at a time by its reference value and score again.

    Only rows where that feature differs are scored again.  ``score`` maps a
    frame with the feature columns to the same frame with ``p``.
    """
    j = candidate.select(*ids, *features).join(reference.select(*ids, *[F.col(f).alias(f"r_{f}") for f in features]), ids)
    base = settle(score(j).withColumnRenamed("p", "p_c"))
    ref = score(base.select(*ids, *[F.col(f"r_{f}").alias(f) for f in features])).select(*ids, F.col("p").alias("p_r"))
    base = settle(base.join(ref, ids))
    swap = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in features])
    wide = base.withColumn("swapped", F.explode(F.array_compact(swap)))
    wide = wide.select(*ids, "swapped", "p_c", "p_r", *[F.when(F.col("swapped") == f, F.col(f"r_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    s = score(wide)
    gap0, gap1 = F.abs(F.col("p_c") - F.col("p_r")), F.abs(F.col("p") - F.col("p_r"))
    flip0, flip1 = (F.col("p_c") >= 0.5) != (F.col("p_r") >= 0.5), (F.col("p") >= 0.5) != (F.col("p_r") >= 0.5)
    return s.groupBy(F.col("swapped").alias("feature")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(gap0 - gap1).alias("mean_reduction"), F.max(F.abs(gap0 - gap1)).alias("max_change"),
        F.count_if(flip0 & ~flip1).alias("resolved"), F.count_if(~flip0 & flip1).alias("introduced"))


def drift_reasons(diff: DataFrame, mapping: DataFrame, ids: list[str], tolerance: float) -> DataFrame:
    """Per row the feature that explains most, by status mismatch first, then by relative difference."""
    basis = F.when(F.col("status_mismatch"), "status").when(F.col("rel_diff") > tolerance, "difference")
    d = diff.withColumn("basis", basis).where("basis IS NOT NULL")
    rank = F.struct((F.col("basis") == "status").cast("int"), F.coalesce("rel_diff", F.lit(0.0)), F.col("feature"))
    top = d.groupBy(*ids).agg(F.max_by(F.struct("feature", "basis"), rank).alias("_t")).select(*ids, "_t.*")
    return top.join(mapping, "feature", "left").groupBy("basis", "group", "feature").agg(F.count(F.lit(1)).alias("rows"))


def guardrails(metrics: DataFrame, limits: dict[str, float], ids: list[str]) -> DataFrame:
    """Metrics above their limit, one row each."""
    long = metrics.unpivot(ids, list(limits), "metric", "value")
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    return long.withColumn("limit", table[F.col("metric")]).where(F.col("value") > F.col("limit"))


def stable_windows(bars: DataFrame, specs: list[tuple[str, str, dict]], windows: list[int], anchors: DataFrame, *, atol: float, rtol: float,
                   layout: Layout = BARS) -> DataFrame:
    """Smallest trailing window whose value agrees with full history at all anchors, for it and all larger windows.

    Each anchor's trailing window becomes its own short series, so every
    ``(anchor, window)`` is one small task of the normal indicator builders.
    """
    base = settle(index_rows(bars, layout))
    full = add_indicators(base, specs, layout)
    outs = [n for n, _, _ in specs]
    at = anchors.select(*layout.key, F.col("position").alias("_a"))
    ref = full.join(at, (full["_i"] == at["_a"]) & _keys(full, at, layout)).select(
        *[full[k] for k in layout.key], "_a", *[full[n].alias(f"r_{n}") for n in outs])
    spread = at.withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    # a bar belongs to the windows of the anchors at most max(windows) rows ahead: equi-join on blocks of rows
    block = max(windows)
    b = base.withColumn("_blk", F.explode(F.array(F.floor(F.col("_i") / block), F.floor(F.col("_i") / block) + 1)))
    s = spread.withColumn("_blk", F.floor(F.col("_a") / block))
    j = b.join(s, [*layout.key, "_blk"]).where((F.col("_i") <= F.col("_a")) & (F.col("_i") > F.col("_a") - F.col("window"))).drop("_blk", "_i")
    lay = Layout(key=(*layout.key, "_a", "window"), time=layout.time, base_seconds=layout.base_seconds, rows=layout.rows)
    part = add_indicators(settle(j), specs, lay)
    last = part.groupBy(*lay.key).agg(*[F.max_by(n, layout.time).alias(n) for n in outs])
    cmp = last.join(ref, [*layout.key, "_a"])
    cells = F.array(*[F.struct(F.lit(n).alias("spec"), F.coalesce(F.abs(F.col(n) - F.col(f"r_{n}")) <= F.lit(atol) + F.lit(rtol) * F.abs(f"r_{n}"),
                                                                  F.col(n).isNull() & F.col(f"r_{n}").isNull()).alias("ok")) for n in outs])
    per = cmp.select("window", F.inline(cells)).groupBy("spec", "window").agg(F.min(F.col("ok").cast("int")).alias("ok"))
    worst = per.groupBy("spec").agg(F.max(F.when(F.col("ok") == 0, F.col("window"))).alias("_bad"))
    good = per.join(worst, "spec").where((F.col("ok") == 1) & (F.col("window") > F.coalesce("_bad", F.lit(0))))
    return worst.select("spec").join(good.groupBy("spec").agg(F.min("window").alias("window")), "spec", "left")


def _keys(a: DataFrame, b: DataFrame, layout: Layout) -> Column:
    out = F.lit(True)
    for k in layout.key:
        out = out & (a[k] == b[k])
    return out


def history_shortfall(needs: DataFrame, available: DataFrame) -> DataFrame:
    """Largest need per asset against the rows at hand."""
    top = needs.groupBy("asset").agg(F.max("with_margin").alias("required"), F.max_by("indicator", F.struct("with_margin", "indicator")).alias("driver"))
    return top.join(available, "asset", "left").withColumn("shortfall", F.greatest(F.col("required") - F.coalesce("rows", F.lit(0)), F.lit(0)))


def config_counts(configs: DataFrame, top: int) -> DataFrame:
    """How often indicators, parameters, assignments, averages and sources occur; top ``n`` of each kind."""
    e = configs.select("indicator", F.explode_outer("params").alias("name", "value"))
    one = configs.select(F.lit("indicator").alias("kind"), F.col("indicator").alias("item"))
    kinds = F.array_compact(F.array(
        F.struct(F.lit("param").alias("kind"), F.col("name").alias("item")),
        F.struct(F.lit("assignment").alias("kind"), F.concat("name", F.lit("="), "value").alias("item")),
        F.when(F.col("name").contains("ma_type"), F.struct(F.lit("ma_type").alias("kind"), F.col("value").alias("item"))),
        F.when(F.col("name").contains("source"), F.struct(F.lit("source").alias("kind"), F.col("value").alias("item")))))
    c = one.unionByName(e.where("name IS NOT NULL").select(F.inline(kinds))).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("kind").orderBy(F.col("count").desc(), "item")  # distinct items only
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def inspect_rows(diff: DataFrame, features: list[str], n: int) -> DataFrame:
    """Largest differences of chosen features."""
    return diff.where(F.col("feature").isin(*features) & F.col("abs_diff").isNotNull()).orderBy(
        F.col("abs_diff").desc(), "feature", "ts").limit(n)


def drop_candidates(stats: DataFrame, *, max_rel: float, max_mismatch: int, max_missing: float) -> DataFrame:
    """Features to consider dropping, each with its reasons, worst first."""
    rules = {"relative_drift": F.col("max_rel") > max_rel, "status_mismatch": F.col("status_mismatches") > max_mismatch,
             "missing": (1 - F.col("compared") / F.col("cells")) > max_missing}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])), "|")
    d = stats.withColumn("reasons", reasons).withColumn("flag", any_of([F.coalesce(c, F.lit(False)) for c in rules.values()]))
    w = Window.orderBy(F.col("flag").desc(), F.col("max_rel").desc_nulls_last(), "feature")  # one row per feature
    return d.withColumn("rank", F.row_number().over(w))


def schema_check(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Differences between a frame's column types and artefact metadata."""
    have = dict(df.dtypes)
    out = [f"missing {c}" for c in expected if c not in have]
    return out + [f"type {c}: {have[c]} != {t}" for c, t in expected.items() if c in have and have[c] != t]


PRECISIONS = ("float32", "float64")     # fixed: names of float precision in artefact metadata


def artefact_problem(active: Column, dataset_precision: Column, dataset_path: Column, metadata_path: Column, model_data_path: Column,
                     model_precision: Column, model_columns: Column) -> Column:
    """First reason for which a dataset and a model must not be audited together, ``ok`` where there is none.

    Paths and model precisions that are NULL or blank are not stated and not compared; a dataset must state its precision.
    """
    def name(c: Column) -> Column:
        return F.nullif(F.lower(F.trim(c)), F.lit(""))

    def place(c: Column) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), r"\\\\+", "/"), "/+$", ""), F.lit(""))

    def differs(a: Column, b: Column) -> Column:
        return a.isNotNull() & ~a.eqNullSafe(b)

    unknown = lambda c: ~F.coalesce(c.isin(*PRECISIONS), F.lit(False))
    of_data, of_model, of_columns = name(dataset_precision), name(model_precision), name(model_columns)
    return (F.when(unknown(of_data), "dataset_precision_unknown").when(differs(of_data, name(active)), "dataset_stale")
            .when(differs(place(metadata_path), place(dataset_path)), "metadata_of_other_dataset")
            .when(differs(place(model_data_path), place(dataset_path)), "model_of_other_dataset")
            .when(of_model.isNotNull() & unknown(of_model), "model_precision_unknown").when(differs(of_model, name(active)), "model_precision_differs")
            .when(of_columns.isNotNull() & unknown(of_columns), "model_columns_unknown").when(differs(of_columns, of_data), "model_columns_differ").otherwise("ok"))


def audit_window(predictions: DataFrame, warmup_seconds: int, key: list[str]) -> DataFrame:
    a = predictions.groupBy(*key).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("decision_rows"))
    return a.withColumn("warmup_start", F.timestamp_seconds(F.unix_seconds("start") - warmup_seconds))


def anchor_values(bars: DataFrame, specs: list[tuple[str, str, dict]], anchors: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Indicator values at anchor rows."""
    full = add_indicators(index_rows(bars, layout), specs, layout)
    return full.join(anchors.select(*layout.key, F.col("position").alias("_i")), [*layout.key, "_i"], "left_semi")


def parity_summary(diff: DataFrame, tolerance: float) -> DataFrame:
    return diff.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("rel_diff") > tolerance).alias("above_tolerance"),
                    F.count_if("status_mismatch").alias("status_mismatches"), F.max("abs_diff").alias("max_abs"),
                    F.count_distinct(F.when((F.col("rel_diff") > tolerance) | F.col("status_mismatch"), F.col("feature"))).alias("drifting_features"))
