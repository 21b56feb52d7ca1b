"""Targets, sample weights, walk-forward folds and the training frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import attach_row, finite, shift
from barloom.operators.ordered import BARS, Layout, index_rows, lagged

# Sample weight of decision rows and of all others.
DECISION_WEIGHT = 0.4625
OTHER_WEIGHT = 0.134375


def exact_target(df: DataFrame, horizon_seconds: int, out: str, price: str = "close",
                 key: tuple[str, ...] = ("symbol",), time: str = "ts") -> DataFrame:
    """1 when the price at exactly ``t + h`` is at or above the price at ``t``; NULL when that row is missing."""
    later = df.select(*key, shift(time, -horizon_seconds).alias(time), F.col(price).alias("_later"))
    hit = (F.col("_later") >= F.col(price)).cast("int")
    return df.join(later, [*key, time], "left").withColumn(out, hit).drop("_later")


def require_unique(df: DataFrame, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Fail the job when a key occurs twice."""
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    message = F.concat_ws(" ", F.lit("duplicate keys:"), *[F.col(k).cast("string") for k in key])
    return counted.where(F.assert_true(F.col("_n") == 1, message).isNull()).drop("_n")


def forward_return(df: DataFrame, rows: int, out: str, price: str = "close", layout: Layout = BARS) -> DataFrame:
    """Return to the price ``rows`` rows ahead (row shift, whatever the gaps)."""
    shifted = lagged(df, {"_later": (price, -rows)}, layout)
    return shifted.withColumn(out, F.col("_later") / F.col(price) - 1).drop("_later")


def proxy_targets(df: DataFrame, horizons: list[int], base_seconds: int, layout: Layout = BARS) -> DataFrame:
    """Row-shift forward returns and exact-time binary targets for several horizons, in one pass each."""
    wide = lagged(df, {f"_f{h}": ("close", -h) for h in horizons}, layout)
    wide = wide.withColumns({f"target_{h}_candle_return": F.col(f"_f{h}") / F.col("close") - 1 for h in horizons})
    wide = wide.drop(*[f"_f{h}" for h in horizons])
    for h in horizons:
        wide = exact_target(wide, h * base_seconds, f"target_{h}_candle_up", key=layout.key, time=layout.time)
    return wide


def decision_mask(time: str = "ts", modulo: int = 5, remainder: int = 4) -> Column:
    return F.minute(time) % modulo == remainder


def decision_weights(df: DataFrame, mask: Column | None = None, out: str = "target_weight") -> DataFrame:
    mask = decision_mask() if mask is None else mask
    return df.withColumn(out, F.when(mask, DECISION_WEIGHT).otherwise(OTHER_WEIGHT))


def weight_summary(df: DataFrame, weight: str) -> DataFrame:
    """One row per weight value, each with the overall minimum, maximum, mean and sum."""
    per = df.groupBy(F.col(weight).alias("weight")).agg(F.count(F.lit(1)).alias("rows"))
    whole = df.agg(F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight"),
                   F.avg(weight).alias("mean_weight"), F.sum(weight).alias("sum_weight"))
    return attach_row(per, whole)


def minimum_weight_counts(df: DataFrame, weight: str, minimum: float, target: str) -> DataFrame:
    keep = F.col(weight) >= minimum
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(keep).alias("rows_after"),
                  F.count_if(keep & (F.col(target) == 1)).alias("positives_after"))


def minimum_weight(df: DataFrame, weight: str, minimum: float) -> DataFrame:
    return df.where(F.col(weight) >= minimum)


def resolve_weight(df: DataFrame, weight: str | None, mask: Column | None, out: str = "w") -> DataFrame:
    """Weight column if present, else derived from the decision mask, else one; must be finite and positive."""
    if weight and weight in df.columns:
        w = F.col(weight).cast("double")
    elif mask is not None:
        w = F.when(mask, DECISION_WEIGHT).otherwise(OTHER_WEIGHT)
    else:
        w = F.lit(1.0)
    ok = finite(w).isNotNull() & (w > 0)
    return df.withColumn(out, F.when(ok, w).otherwise(F.raise_error(F.lit("weight must be finite and positive")).cast("double")))


def training_frame(df: DataFrame, target: str, drop: tuple[str, ...] = (), keep: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Rows with a binary target; infinities to NULL; non-numeric and excluded columns dropped."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    cols = []
    for name, kind in df.dtypes:
        if name in keep or name == target:
            cols.append(F.col(name))
        elif name not in drop and kind in numeric:
            cols.append(finite(F.col(name).cast("double")).alias(name))
    binary = F.col(target).isin(0, 1)
    return df.where(F.col(target).isNotNull()).select(*cols).where(
        F.when(binary, True).otherwise(F.raise_error(F.lit("target must be binary")).cast("boolean")))


def class_distribution(df: DataFrame, target: str, weight: str) -> DataFrame:
    whole = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    per = df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"))
    return attach_row(per, whole).withColumns({
        "share": F.col("rows") / F.col("_n"), "weight_share": F.col("weight") / F.col("_w")}).drop("_n", "_w")


def global_index(df: DataFrame, time: str = "ts", tie: tuple[str, ...] = ("symbol",), rows: int = 65_536,
                 out: str = "row_idx") -> DataFrame:
    """Position of every row in overall time order; a task sees about ``rows`` of them, whatever the time they cover."""
    lay = Layout(key=(), time=time, rows=rows, by_rows=True)
    if not tie:
        return index_rows(df, lay, out)
    return index_rows(df, lay, out, order=tie)


def fold_table(spark, rows: Column | int, count: DataFrame | None, folds: int, ratio: float) -> DataFrame:
    """Walk-forward ranges: test = floor(n / (k + 1/ratio)), train = floor(test / ratio), stride = test."""
    n = count.select(F.col("n")) if count is not None else spark.range(1).select(F.lit(rows).alias("n"))
    test = F.floor(F.col("n") / F.lit(folds + 1.0 / ratio))
    train = F.floor(F.col("test_size") / F.lit(ratio))
    f = F.col("fold")
    return (n.withColumn("test_size", test).withColumn("train_size", train)
            .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
            .select("fold", (f * F.col("test_size")).alias("train_start"),
                    (f * F.col("test_size") + F.col("train_size")).alias("train_end"),
                    (f * F.col("test_size") + F.col("train_size")).alias("test_start"),
                    ((f + 1) * F.col("test_size") + F.col("train_size")).alias("test_end"), "n")
            .where(F.col("test_end") <= F.col("n")).drop("n"))


def assign_folds(indexed: DataFrame, folds: DataFrame, idx: str = "row_idx") -> DataFrame:
    """Every row once per fold it trains or tests in; the fold table holds one row per fold."""
    i = F.col(idx)
    role = F.when((i >= F.col("test_start")) & (i < F.col("test_end")), "test").when(
        (i >= F.col("train_start")) & (i < F.col("train_end")), "train")
    return indexed.join(F.broadcast(folds), (i >= F.col("train_start")) & (i < F.col("test_end"))).withColumn("role", role)


def recency_weight(fold: Column, folds: int, low: float = 1.0, high: float = 1.5) -> Column:
    if folds <= 1:
        return F.lit(low)
    return F.lit(low) + (F.lit(high) - F.lit(low)) * fold / F.lit(folds - 1.0)


def fold_usable_features(assigned: DataFrame, features: list[str]) -> DataFrame:
    """Per fold, which features have any value in the training rows."""
    wide = assigned.where("role = 'train'").groupBy("fold").agg(*[F.count(c).alias(c) for c in features])
    return wide.unpivot(["fold"], features, "feature", "train_values").withColumn("usable", F.col("train_values") > 0)


def rows_for(assigned: DataFrame, mode: str, decision: Column) -> DataFrame:
    """Row selection: ``all`` keeps everything, ``train_decision`` / ``eval_decision`` / ``decision`` restrict one role or both."""
    role = F.col("role")
    rule = {"all": F.lit(True), "train_decision": (role != "train") | decision,
            "eval_decision": (role != "test") | decision, "decision": decision}[mode]
    return assigned.where(rule)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))


def half_life_weight(age: Column, half_life: float) -> Column:
    return F.exp(F.lit(-math.log(2.0) / half_life) * age)


