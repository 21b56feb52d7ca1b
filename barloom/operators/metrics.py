"""Classification metrics, fold summaries, variant comparison and segment scoring."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import attach_row, clip, col
from barloom.operators.ordered import settle
from barloom.operators.quantiles import quantile_columns

LOWER_IS_BETTER = {"brier", "log_loss"}
_P_MIN = 1e-15


def brier(p, y, w) -> Column:
    d = col(p) - col(y)
    return F.sum(col(w) * d * d) / F.sum(col(w))


def log_loss(p, y, w) -> Column:
    q = clip(col(p), _P_MIN, 1 - _P_MIN)
    return -F.sum(col(w) * (col(y) * F.ln(q) + (1 - col(y)) * F.ln(1 - q))) / F.sum(col(w))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def classification(p, y, w, threshold: float = 0.5, prefix: str = "") -> list[Column]:
    """All metrics of one group as aggregates, so any number of groups costs one pass."""
    p, y, w = col(p), col(y), col(w)
    hit = (p >= threshold).cast("int")

    def mass(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))

    tp, fp = mass((hit == 1) & (y == 1)), mass((hit == 1) & (y == 0))
    tn, fn = mass((hit == 0) & (y == 0)), mass((hit == 0) & (y == 1))
    precision, recall, spec = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1 = F.when(precision + recall > 0, precision * recall * 2 / (precision + recall)).otherwise(0.0)
    out = {"accuracy": (tp + tn) / F.sum(w), "precision": precision, "recall": recall, "f1": f1,
           "balanced_accuracy": (recall + spec) / 2, "brier": brier(p, y, w), "log_loss": log_loss(p, y, w)}
    return [c.alias(prefix + n) for n, c in out.items()]


METRICS = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "brier", "log_loss"]


def scoped(preds: DataFrame, decision: str) -> DataFrame:
    """Each row in scope ``all`` and, when it is a decision row, also in ``decision``."""
    scopes = F.when(col(decision), F.array(F.lit("all"), F.lit("decision"))).otherwise(F.array(F.lit("all")))
    return preds.withColumn("scope", F.explode(scopes))


def metrics_by(preds: DataFrame, keys: list[str], p="p", y="y", w="w") -> DataFrame:
    one = preds.withColumn("_one", F.lit(1.0))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(col(y).cast("double")).alias("positive_rate"),
                                  F.avg((col(p) >= 0.5).cast("double")).alias("predicted_rate"),
                                  *classification(p, y, w, prefix="w_"), *classification(p, y, "_one"))


def fold_summary(folds: DataFrame, keys: list[str], metric: str, weight: str | None = None, penalty: float = 0.0,
                 lower_is_better: bool = True) -> DataFrame:
    """Mean, weighted mean and population deviation over folds, with a stability-adjusted objective."""
    w = F.col(weight) if weight else F.lit(1.0)
    base = F.sum(F.col(metric) * w) / F.sum(w)
    sd = F.stddev_pop(metric)
    sgn = 1.0 if lower_is_better else -1.0
    return folds.groupBy(*keys).agg(F.avg(metric).alias("mean"), base.alias("weighted_mean"), sd.alias("std"),
                                    (base + sgn * penalty * sd).alias("objective"))


def variant_summary(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return folds.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def baseline_deltas(results: DataFrame, context: list[str], variant: str, baseline: str, metric: str,
                    lower_is_better: bool = True, tie: float = 1e-15) -> DataFrame:
    """Per variant: mean delta to the baseline of the same context, wins, losses and ties."""
    base = results.where(F.col(variant) == baseline).select(*context, F.col(metric).alias("_base"))
    d = results.where(F.col(variant) != baseline).join(base, context).withColumn("delta", F.col(metric) - F.col("_base"))
    good = -F.col("delta") if lower_is_better else F.col("delta")
    return d.groupBy(variant).agg(F.count(F.lit(1)).alias("contexts"), F.avg("delta").alias("mean_delta"),
                                  F.count_if(good > tie).alias("wins"), F.count_if(good < -tie).alias("losses"),
                                  F.count_if(F.abs("delta") <= tie).alias("ties"))


def top_results(results: DataFrame, order: list[Column], n: int) -> DataFrame:
    return results.orderBy(*order).limit(n)


def compare_variants(left: DataFrame, right: DataFrame, scope: str, metrics: list[str], tie: float = 1e-15) -> DataFrame:
    """Metric by metric: values, delta, and the winner given each metric's direction."""
    a = left.unpivot([scope], metrics, "metric", "left_value")
    b = right.unpivot([scope], metrics, "metric", "right_value")
    d = a.join(b, [scope, "metric"]).withColumn("delta", F.col("right_value") - F.col("left_value"))
    gain = F.when(F.col("metric").rlike("(" + "|".join(LOWER_IS_BETTER) + ")$"), -F.col("delta")).otherwise(F.col("delta"))
    return d.withColumn("winner", F.when(F.abs("delta") <= tie, "tie").when(gain > 0, "right").otherwise("left"))


def recommend(comparison: DataFrame, scope_value: str, primary: str) -> DataFrame:
    return comparison.where((F.col("scope") == scope_value) & (F.col("metric") == primary)).select(
        "metric", "delta", F.when(F.col("winner") == "right", "use_right").otherwise("keep_left").alias("recommendation"))


def null_ratio(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("double")).alias("null_ratio"))


def winsorised_mean(df: DataFrame, keys: list[str], value: str, clip_q: float) -> DataFrame:
    """Mean after clipping to the ``clip_q`` and ``1 - clip_q`` quantiles of each group, with the median beside it."""
    cuts = quantile_columns(df, keys, value, {"_lo": clip_q, "_hi": 1 - clip_q, "median": 0.5})
    clipped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    joined = df.join(cuts, keys) if keys else attach_row(df, cuts)
    return joined.groupBy(*keys).agg(F.avg(clipped).alias("winsorised_mean"), F.max("median").alias("median"))


def segment_scores(rows: DataFrame, x: str, y: str, *, segments: int, train_frac: float, gap: int, q_ext: float, q_mid: float,
                   clip_q: float, min_bucket: int, idx: str = "row_idx", stat: str = "mean_clip", keys: list[str] = ()) -> DataFrame:
    """Per time segment: how far the extremes of ``x`` move ``y`` away from its middle, out of sample.

    Cut-offs come from the first part of a segment, means from the rows after a gap.
    ``keys`` scores many candidates at once.
    """
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = rows.join(n, keys) if keys else attach_row(rows, n)
    i, total = F.col(idx), F.col("_n")
    # segment s holds rows [s*n // k, (s+1)*n // k)
    r = r.withColumn("segment", F.floor(((i + 1) * segments - 1) / total).cast("int"))
    start, end = F.floor(F.col("segment") * total / segments), F.floor((F.col("segment") + 1) * total / segments)
    cut = start + F.floor(F.lit(train_frac) * (end - start))
    part = F.when(i < cut, "train").when((i >= cut + gap) & (i < end), "test")
    r = settle(r.withColumn("_part", part))
    ids = [*keys, "segment"]
    cuts = quantile_columns(r.where("_part = 'train'"), ids, x,
                            {"lo_ext": q_ext, "hi_ext": 1 - q_ext, "mid_lo": 0.5 - q_mid, "mid_hi": 0.5 + q_mid})
    t = r.where("_part = 'test'").join(settle(cuts).where("lo_ext < hi_ext AND mid_lo <= mid_hi"), ids)
    bucket = F.when(F.col(x) < F.col("lo_ext"), "bot").when(F.col(x) > F.col("hi_ext"), "top").when(
        F.col(x).between(F.col("mid_lo"), F.col("mid_hi")), "mid")
    t = settle(t.withColumn("bucket", bucket))
    noise = t.groupBy(*ids).agg(F.stddev_pop(y).alias("_sd"))
    inside = t.where("bucket IS NOT NULL")
    means = settle(winsorised_mean(inside, [*ids, "bucket"], y, clip_q)).withColumn(
        "_mean", F.col("median") if stat == "median" else F.col("winsorised_mean"))
    sizes = inside.groupBy(*ids, "bucket").agg(F.count(F.lit(1)).alias("_rows"))
    wide = means.join(sizes, [*ids, "bucket"]).groupBy(*ids).agg(*[
        F.max(F.when(F.col("bucket") == b, F.col(c))).alias(f"{b}{c}") for b in ("bot", "mid", "top") for c in ("_mean", "_rows")])
    big = reduce(lambda p, q: p & q, [F.coalesce(F.col(f"{b}_rows") >= min_bucket, F.lit(False)) for b in ("bot", "mid", "top")])
    raw = F.abs(F.col("top_mean") - F.col("mid_mean")) + F.abs(F.col("bot_mean") - F.col("mid_mean"))
    err = F.lit(math.sqrt(2 / math.pi)) * F.col("_sd") * (F.sqrt(1 / F.col("top_rows") + 1 / F.col("mid_rows"))
                                                        + F.sqrt(1 / F.col("bot_rows") + 1 / F.col("mid_rows")))
    score = F.when(big, F.greatest(raw - err, F.lit(0.0)))
    return wide.join(noise, ids).select(*ids, score.alias("score"))


def information_ratio(scores: DataFrame, segments: int, keys: list[str] = (), min_valid: int = 2,
                      recency: tuple[float, float] | None = None) -> DataFrame:
    """Mean over deviation of valid segment scores; recency weights grow linearly over segments."""
    lo, hi = recency or (1.0, 1.0)
    w = F.lit(lo) + F.lit(hi - lo) * F.col("segment") / F.lit(max(segments - 1, 1))
    ok = scores.where("score IS NOT NULL")
    agg = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid"), (F.sum(F.col("score") * w) / F.sum(w)).alias("_m"),
                                F.stddev_samp("score").alias("_s"))
    ir = F.when((F.col("valid") >= max(min_valid, 2)) & (F.col("_s") > 0) & (F.col("_m") > 0), F.col("_m") / F.col("_s")).otherwise(0.0)
    return agg.select(*keys, "valid", ir.alias("ir"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Rank of summary rows (one per candidate); inputs are already reduced."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
