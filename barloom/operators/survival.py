"""Streaks of correct decisions: lengths, survival, recency weighting, scenario replay, recommendations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.columns import attach_row, epoch
from barloom.operators.clean import keep_last
from barloom.operators.ordered import Layout, lagged, run_bounds

MIN_SURVIVAL = 0.5        # fixed: a streak length counts while it survives in half of the rows
_DAY = 86_400


def analysis_frame(preds: DataFrame, decision: str, decision_delay: int, layout: Layout) -> DataFrame:
    """Valid decision rows, last one per time, with side, correctness and day."""
    ok = preds.where(F.col("p").between(0.0, 1.0) & F.col("y").isin(0, 1) & F.col(decision))
    one = keep_last(ok, (*layout.key, layout.time), F.col("p"))
    side = (F.col("p") >= 0.5).cast("int")
    at = F.timestamp_seconds(epoch(layout.time) + decision_delay)
    return one.withColumns({"side": side, "correct": side == F.col("y"), "event_time": at, "event_day": F.date_trunc("day", at)})


def forward_streaks(frame: DataFrame, layout: Layout) -> DataFrame:
    """Consecutive correct rows from each row onward."""
    edge = lagged(frame, {"_pc": ("correct", 1)}, layout)
    runs = run_bounds(edge, F.col("_pc").isNull() | (F.col("_pc") != F.col("correct")), layout)
    value = F.when(F.col("correct"), F.col("run_end") - F.col("_i") + 1).otherwise(0)
    return runs.withColumn("streak", value.cast("int")).withColumn(
        "completed", F.col("correct") & (F.col("_i") == F.col("run_start"))).drop("_pc")


def completed_stats(streaks: DataFrame, keys: list[str]) -> DataFrame:
    """Length statistics of whole runs.  Lengths are few, so counts per length carry the quantiles."""
    counts = streaks.where("completed").groupBy(*keys, "streak").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("runs"), (F.sum(F.col("streak") * F.col("c")) / F.sum("c")).alias("mean"),
                                     *[F.percentile("streak", p, F.col("c")).alias(n) for n, p in
                                       (("median", .5), ("p75", .75), ("p90", .9), ("p95", .95), ("p99", .99))], F.max("streak").alias("max"))


def survival(streaks: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """P(streak >= k) per k, from counts per length and a reverse running sum over them."""
    w = F.col(weight) if weight else F.lit(1.0)
    per = streaks.groupBy(*keys, "streak").agg(F.count(F.lit(1)).alias("c"), F.sum(w).alias("wc"))
    whole = per.groupBy(*keys).agg(F.sum("c").alias("_n"), F.sum("wc").alias("_w"), F.max("streak").alias("_top"))
    ks = whole.where("_top >= 1").select(*keys, "_n", "_w", F.explode(F.sequence(F.lit(1), F.col("_top"))).alias("k"))
    filled = ks.join(per.withColumnRenamed("streak", "k"), [*keys, "k"], "left").fillna(0, ["c", "wc"])
    down = Window.partitionBy(*keys).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per length
    return filled.select(*keys, "k", F.sum("c").over(down).alias("raw_count"), (F.sum("c").over(down) / F.col("_n")).alias("raw_probability"),
                         F.sum("wc").over(down).alias("weighted_count"), (F.sum("wc").over(down) / F.col("_w")).alias("weighted_probability"))


def with_recency(frame: DataFrame, half_lives: list[int]) -> DataFrame:
    """Each row once per half-life with weight 0.5^(age / half-life)."""
    newest = frame.agg(F.max("event_time").alias("_newest"))
    f = attach_row(frame, newest)
    age = (epoch("_newest") - epoch("event_time")) / _DAY
    return f.select("*", F.explode(F.array(*[F.lit(h) for h in half_lives])).alias("half_life")).withColumn(
        "w", F.pow(F.lit(0.5), age / F.col("half_life"))).drop("_newest")


def weight_summary(weighted: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("correct").cast("double")
    return weighted.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("weight_sum"),
                                       (F.pow(F.sum("w"), F.lit(2)) / F.sum(F.col("w") * F.col("w"))).alias("ess"),
                                       F.avg(ok).alias("accuracy"), (F.sum(ok * F.col("w")) / F.sum("w")).alias("weighted_accuracy"))


def max_steps(surv: DataFrame, keys: list[str], prob: str) -> DataFrame:
    return surv.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(prob) >= MIN_SURVIVAL, F.col("k"))), F.lit(0)).alias("max_steps"))


def rolling(frame: DataFrame, days: list[int]) -> DataFrame:
    """Each row once per trailing window that contains it."""
    newest = frame.agg(F.max("event_time").alias("_newest"))
    f = attach_row(frame, newest).select("*", F.explode(F.array(*[F.lit(d) for d in days])).alias("window_days"))
    return f.where(epoch("event_time") >= epoch("_newest") - F.col("window_days") * _DAY).drop("_newest")


def basic_summary(frame: DataFrame) -> DataFrame:
    days = frame.groupBy("event_day").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("correct").cast("int")).alias("ok"),
                                          F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
    return days.agg(F.sum("c").alias("rows"), (F.sum("ok") / F.sum("c")).alias("accuracy"), F.count(F.lit(1)).alias("days"),
                    F.avg("c").alias("per_day_mean"), F.percentile("c", 0.5).alias("per_day_median"), F.min("lo").alias("start"), F.max("hi").alias("end"))


def daily_draws(streaks: DataFrame, starts: list[int], seeds: list[int], keys: list[str]) -> DataFrame:
    """Seeded start rows per day without replacement: the ``n`` smallest hashes of the day.

    Only bounded per-day top-n sets are built, by merging sorted arrays map-side.
    """
    most = max(starts)
    h = F.xxhash64(*keys, "_i", "seed")
    d = streaks.select(*keys, "_i", "streak", "event_day").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    d = d.withColumn("_h", h)
    salt = F.pmod(F.col("_h"), F.lit(16))
    first = Window.partitionBy(*keys, "event_day", "seed", "_salt").orderBy("_h", "_i")
    some = d.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    final = Window.partitionBy(*keys, "event_day", "seed").orderBy("_h", "_i")
    ranked = some.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= most)
    return ranked.select(*keys, "seed", "event_day", "_i", "streak", F.explode(F.array(*[F.lit(n) for n in starts])).alias("starts_per_day"),
                         "_r").where(F.col("_r") <= F.col("starts_per_day")).drop("_r")


def replay(draws: DataFrame, steps: list[int], price_cap: float, keys: list[str], rows: DataFrame) -> DataFrame:
    """Non-overlapping runs per scenario; one task walks the drawn starts of one (scenario, key).

    A walk sees drawn starts only (days times starts), never the rows themselves.
    ``rows`` gives the series length per key.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in draws.select(*keys).schema)
    grid = draws.join(rows, keys).withColumn("max_steps", F.explode(F.array(*[F.lit(s) for s in steps])))
    scenario = [*keys, "starts_per_day", "max_steps", "seed"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        limit, n = int(pdf["max_steps"].iloc[0]), int(pdf["n"].iloc[0])
        win_pnl, free = (1.0 / price_cap) ** limit - 1.0, 0
        keep = []
        for i, s, day in zip(pdf["_i"], pdf["streak"], pdf["event_day"]):
            if i < free or i + limit > n:
                continue
            won = s >= limit
            length = limit if won else s + 1
            keep.append((day, int(min(s, limit)), int(length), bool(won), win_pnl if won else -1.0))
            free = i + length
        out = pd.DataFrame(keep, columns=["event_day", "wins", "length", "reached", "pnl"])
        for c in scenario:
            out[c] = pdf[c].iloc[0]
        return out[[*scenario, "event_day", "wins", "length", "reached", "pnl"]]

    return grid.groupBy(*scenario).applyInPandas(
        walk, f"{types}, starts_per_day int, max_steps int, seed int, event_day timestamp, wins int, length int, reached boolean, pnl double")


def scenario_summary(runs: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Per scenario and seed: totals, daily statistics over all days, drawdown of the cumulated daily result."""
    scen = [*keys, "starts_per_day", "max_steps", "seed"]
    daily = runs.groupBy(*scen, "event_day").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("runs"),
                                                 F.sum("length").alias("steps"), F.sum(F.col("reached").cast("int")).alias("reached"),
                                                 F.sum("wins").alias("wins"))
    full = runs.select(*scen).distinct().join(days, keys).join(daily, [*scen, "event_day"], "left").fillna(0)
    up = Window.partitionBy(*scen).orderBy("event_day").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    f = full.withColumn("_cum", F.sum("pnl").over(up))
    f = f.withColumn("_peak", F.greatest(F.max("_cum").over(up), F.lit(0.0)))
    return f.groupBy(*scen).agg(F.sum("runs").alias("run_count"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_daily"),
                                F.percentile("pnl", 0.5).alias("median_daily"), F.percentile("pnl", 0.05).alias("p05_daily"),
                                F.min("pnl").alias("worst_daily"), F.avg((F.col("pnl") < 0).cast("double")).alias("losing_days"),
                                F.max(F.col("_peak") - F.col("_cum")).alias("max_drawdown"), F.sum("steps").alias("steps"),
                                F.sum("reached").alias("reached"), F.sum("wins").alias("wins"))


def scenario_aggregate(by_seed: DataFrame) -> DataFrame:
    """Over seeds, with the risk/reward score used for ordering."""
    a = by_seed.groupBy("starts_per_day", "max_steps").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("total_pnl").alias("mean_total"), F.percentile("total_pnl", 0.5).alias("median_total"),
        F.percentile("total_pnl", 0.05).alias("p05_total"), F.percentile("total_pnl", 0.95).alias("p95_total"),
        F.min("total_pnl").alias("worst_total"), F.avg("losing_days").alias("losing_days"), F.avg("max_drawdown").alias("mean_drawdown"),
        (F.sum("reached") / F.sum("run_count")).alias("share_reached"), (F.sum("steps") / F.sum("run_count")).alias("steps_per_run"))
    best = a.agg(F.max("mean_total").alias("_best"))
    a = attach_row(a, best)
    return a.withColumns({"best_fraction": F.when(F.col("_best") > 0, F.col("mean_total") / F.col("_best")).otherwise(0.0),
                          "score": F.col("mean_total") - F.col("mean_drawdown") * 0.25 - F.col("losing_days") * 20.0}).drop("_best")


def length_shares(runs: DataFrame, keys: list[str]) -> DataFrame:
    per = runs.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("c"))
    whole = per.groupBy(*keys).agg(F.sum("c").alias("_n"))
    return per.join(whole, keys).select(*keys, "length", (F.col("c") / F.col("_n")).alias("share"))


def recommend_steps(chosen: DataFrame) -> DataFrame:
    """Conservative = lower median, balanced = half-even rounded median of the positive recent choices."""
    good = chosen.where("max_steps > 0")
    wide = good.agg(F.percentile("max_steps", 0.5).alias("_m"), F.sort_array(F.collect_list("max_steps")).alias("_v"),  # one per window
                    F.percentile("max_steps", 0.75).alias("_q"))
    low = F.element_at("_v", F.floor((F.size("_v") - 1) / 2).cast("int") + 1)
    spread = F.array_max("_v") - F.array_min("_v") >= 4
    bal = F.bround(F.col("_m"), 0).cast("int")
    bal = F.when(spread, F.least(bal, F.greatest(F.lit(1), F.floor("_q").cast("int")))).otherwise(bal)
    empty = F.size("_v") == 0
    return wide.select(F.when(empty, 1).otherwise(F.greatest(F.lit(1), low)).alias("conservative"),
                       F.when(empty, 1).otherwise(F.greatest(F.lit(1), bal)).alias("balanced"))


def recommend_starts(summary: DataFrame, steps: int, fraction: float) -> DataFrame:
    """Fewest starts that reach a fraction of the best mean result at this step limit."""
    s = summary.where(F.col("max_steps") == steps)
    best = s.agg(F.max("mean_total").alias("_b"))
    v = attach_row(s, best).where((F.col("_b") <= 0) | (F.col("mean_total") >= F.col("_b") * fraction))
    return v.orderBy("starts_per_day", "mean_drawdown", "losing_days", F.col("mean_total").desc()).limit(1).select("starts_per_day", "mean_total")


