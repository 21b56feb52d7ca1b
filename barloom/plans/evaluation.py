"""Queries: targets, folds, metrics, survival, source comparison."""

from pyspark.sql import functions as F

from barloom.operators import compare, metrics as mt, quantiles as qt, survival as sv, targets as tg
from barloom.operators.ordered import lagged, settle
from barloom.plans.base import CTES, HOUR, HOURLY, query

# Predictions: a fixed function of the last two closes; target five bars ahead.
CTES["preds"] = """SELECT symbol, ts, close, p, target AS y, CASE WHEN hour(ts) % 5 = 4 THEN 0.4625 ELSE 0.134375 END AS w,
      hour(ts) % 5 = 4 AS decision, row_number() OVER (ORDER BY ts, symbol) - 1 AS row_idx
    FROM (SELECT *, c1 / (close + c1) AS p FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c1 FROM targeted))
    WHERE p IS NOT NULL AND target IS NOT NULL"""


def preds(t):
    d = lagged(tg.exact_target(t.hourly, 5 * HOUR, "y"), {"c1": ("close", 1)}, HOURLY)
    d = d.withColumns({"p": F.col("c1") / (F.col("close") + F.col("c1")), "decision": F.hour("ts") % 5 == 4})
    d = tg.decision_weights(d, F.col("decision"), "w").where("p IS NOT NULL AND y IS NOT NULL")
    return d.select("symbol", "ts", "close", "p", "y", "w", "decision")


def indexed_preds(t):
    return tg.global_index(settle(preds(t)))


@query("exact_targets", "TGT01 TGT03", "symbol:s ts:t target_1_candle_up:i target_5_candle_up:i target_1_candle_return target_5_candle_return",
       """SELECT a.symbol, a.ts, CASE WHEN b.close IS NULL THEN NULL WHEN b.close >= a.close THEN 1 ELSE 0 END AS target_1_candle_up,
          CASE WHEN c.close IS NULL THEN NULL WHEN c.close >= a.close THEN 1 ELSE 0 END AS target_5_candle_up,
          a.f1/a.close - 1 AS target_1_candle_return, a.f5/a.close - 1 AS target_5_candle_return
          FROM (SELECT *, lead(close) OVER w AS f1, lead(close, 5) OVER w AS f5 FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY ts)) a
          LEFT JOIN hourly b ON a.symbol = b.symbol AND b.ts = a.ts + INTERVAL 1 HOUR
          LEFT JOIN hourly c ON a.symbol = c.symbol AND c.ts = a.ts + INTERVAL 5 HOUR""")
def exact_targets(t):
    return tg.proxy_targets(settle(tg.require_unique(t.hourly)), [1, 5], HOUR, HOURLY)


@query("forward_returns", "TGT02", "symbol:s ts:t r3",
       "SELECT symbol, ts, lead(close, 3) OVER (PARTITION BY symbol ORDER BY ts)/close - 1 AS r3 FROM hourly")
def forward_returns(t):
    return tg.forward_return(t.hourly, 3, "r3", layout=HOURLY)


@query("decision_weights", "TGT04 TGT05", "weight rows:i min_weight max_weight mean_weight sum_weight",
       """SELECT weight, count(*) AS rows, any_value(a) AS min_weight, any_value(b) AS max_weight, any_value(c) AS mean_weight, any_value(d) AS sum_weight
          FROM (SELECT w AS weight, min(w) OVER () AS a, max(w) OVER () AS b, avg(w) OVER () AS c, sum(w) OVER () AS d FROM (
            SELECT CASE WHEN minute(ts) % 5 = 4 THEN 0.4625 ELSE 0.134375 END AS w FROM ticks)) GROUP BY 1""")
def decision_weights(t):
    return tg.weight_summary(tg.decision_weights(t.ticks), "target_weight")


@query("minimum_weight", "TGT06 TGT07", "rows_before:i rows_after:i positives_after:i",
       "SELECT count(*) AS rows_before, count_if(w >= 0.4) AS rows_after, count_if(w >= 0.4 AND y = 1) AS positives_after FROM preds")
def minimum_weight(t):
    return tg.minimum_weight_counts(tg.resolve_weight(preds(t), "w", None, "w2"), "w2", 0.4, "y")


@query("class_distribution", "TGT09", "target:i rows:i weight share weight_share",
       """SELECT y AS target, count(*) AS rows, sum(w) AS weight, count(*) / (SELECT count(*) FROM preds)::DOUBLE AS share,
          sum(w) / (SELECT sum(w) FROM preds) AS weight_share FROM preds GROUP BY 1""")
def class_distribution(t):
    frame = tg.training_frame(preds(t).withColumn("noise", F.lit(float("inf"))), "y", drop=("close",))
    return tg.class_distribution(frame.where("noise IS NULL"), "y", "w")


CTES["folded"] = """SELECT *, CASE WHEN row_idx >= ts0 AND row_idx < te0 THEN 'test' ELSE 'train' END AS role FROM preds JOIN (
      SELECT fold, fold*test AS tr0, fold*test+train AS ts0, (fold+1)*test+train AS te0 FROM (
        SELECT *, CAST(floor(test / 0.25) AS BIGINT) AS train FROM (SELECT n, CAST(floor(n / (4 + 4.0)) AS BIGINT) AS test FROM (SELECT count(*) AS n FROM preds))),
      range(4) r(fold) WHERE (fold+1)*test+train <= n) f ON row_idx >= tr0 AND row_idx < te0"""


def folded(t):
    idx = settle(indexed_preds(t))
    folds = tg.fold_table(t.spark, 0, idx.agg(F.count(F.lit(1)).alias("n")), 4, 0.25)
    return tg.assign_folds(idx, folds)


@query("walk_forward_folds", "TGT10 TGT13", "fold:i role:s rows:i first_idx:i last_idx:i decision_rows:i",
       "SELECT fold, role, count(*) AS rows, min(row_idx) AS first_idx, max(row_idx) AS last_idx, count_if(decision) AS decision_rows FROM folded GROUP BY 1, 2")
def walk_forward_folds(t):
    return tg.rows_for(folded(t), "all", F.col("decision")).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"),
        F.count_if("decision").alias("decision_rows"))


@query("fold_row_modes", "TGT11 TGT13", "fold:i rows:i recency",
       "SELECT fold, count(*) AS rows, 1 + 0.5*fold/3.0 AS recency FROM folded WHERE role = 'train' OR decision GROUP BY 1")
def fold_row_modes(t):
    return tg.rows_for(folded(t), "eval_decision", F.col("decision")).groupBy("fold").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "recency", tg.recency_weight(F.col("fold"), 4))


@query("fold_usable_features", "TGT12", "fold:i feature:s train_values:i usable:i",
       """SELECT fold, 'p' AS feature, count(p) AS train_values, count(p) > 0 AS usable FROM folded WHERE role = 'train' GROUP BY 1
          UNION ALL SELECT fold, 'late', count(CASE WHEN row_idx > 2500 THEN p END), count(CASE WHEN row_idx > 2500 THEN p END) > 0 FROM folded WHERE role = 'train' GROUP BY 1""")
def fold_usable_features(t):
    return tg.fold_usable_features(folded(t).withColumn("late", F.when(F.col("row_idx") > 2500, F.col("p"))), ["p", "late"])


_M = " ".join(mt.METRICS)


def _metric_sql(w):
    s = {n: f"sum(CASE WHEN {c} THEN {w} ELSE 0 END)" for n, c in {
        "tp": "p >= 0.5 AND y = 1", "fp": "p >= 0.5 AND y = 0", "tn": "p < 0.5 AND y = 0", "fn": "p < 0.5 AND y = 1"}.items()}
    pr, rc, sp = (f"coalesce({s[a]}/nullif({s[a]}+{s[b]},0),0)" for a, b in (("tp", "fp"), ("tp", "fn"), ("tn", "fp")))
    q = "least(greatest(p, 1e-15), 1-1e-15)"
    return {"accuracy": f"({s['tp']}+{s['tn']})/sum({w})", "precision": pr, "recall": rc, "f1": f"coalesce(2*{pr}*{rc}/nullif({pr}+{rc},0),0)",
            "balanced_accuracy": f"({rc}+{sp})/2", "brier": f"sum({w}*(p-y)*(p-y))/sum({w})",
            "log_loss": f"-sum({w}*(y*ln({q})+(1-y)*ln(1-{q})))/sum({w})"}


def _metric_cols(w, prefix=""):
    return ", ".join(f"{e} AS {prefix}{n}" for n, e in _metric_sql(w).items())


_MCOLS = "rows:i positive_rate predicted_rate " + _M + " " + " ".join(f"w_{m}" for m in mt.METRICS)
_MSQL = f"count(*) AS rows, avg(y) AS positive_rate, avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS predicted_rate, {_metric_cols('1.0')}, {_metric_cols('w', 'w_')}"


@query("scope_metrics", "MET01 MET02 MET03 MET04 MET05", "scope:s " + _MCOLS,
       f"SELECT scope, {_MSQL} FROM (SELECT *, 'all' AS scope FROM preds UNION ALL SELECT *, 'decision' FROM preds WHERE decision) GROUP BY 1")
def scope_metrics(t):
    return mt.metrics_by(mt.scoped(preds(t), "decision"), ["scope"])


CTES["fold_metrics"] = f"SELECT fold, symbol, {_MSQL} FROM folded WHERE role = 'test' AND decision GROUP BY 1, 2"


def fold_metrics(t):
    return mt.metrics_by(folded(t).where("role = 'test' AND decision"), ["fold", "symbol"])


@query("fold_metrics", "MET06 MET15", "fold:i symbol:s " + _MCOLS, "SELECT * FROM fold_metrics")
def fold_metrics_query(t):
    return fold_metrics(t)


@query("fold_summary", "MET07 MET15", "symbol:s mean weighted_mean std objective",
       """SELECT symbol, avg(log_loss) AS mean, sum(log_loss*(1+fold))/sum(1+fold) AS weighted_mean, stddev_pop(log_loss) AS std,
          sum(log_loss*(1+fold))/sum(1+fold) + 0.5*stddev_pop(log_loss) AS objective FROM fold_metrics GROUP BY 1""")
def fold_summary(t):
    return mt.fold_summary(fold_metrics(t).withColumn("fw", F.col("fold") + 1.0), ["symbol"], "log_loss", "fw", 0.5)


@query("baseline_deltas", "MET08 MDL13", "symbol:s contexts:i mean_delta wins:i losses:i ties:i",
       """SELECT a.symbol, count(*) AS contexts, avg(a.brier-b.brier) AS mean_delta, count_if(a.brier < b.brier) AS wins, count_if(a.brier > b.brier) AS losses,
          count_if(a.brier = b.brier) AS ties FROM fold_metrics a JOIN fold_metrics b ON a.fold = b.fold AND b.symbol = 'view' AND a.symbol <> 'view' GROUP BY 1""")
def baseline_deltas(t):
    return mt.baseline_deltas(settle(fold_metrics(t)), ["fold"], "symbol", "view", "brier")


@query("top_results", "MET09 MDL10", "fold:i symbol:s brier", "SELECT fold, symbol, brier FROM fold_metrics ORDER BY brier, fold, symbol LIMIT 7")
def top_results(t):
    return mt.top_results(fold_metrics(t), [F.col("brier"), F.col("fold"), F.col("symbol")], 7)


@query("exact_quantiles", "MET10 OWA05", "symbol:s q quantile",
       "SELECT symbol, q, quantile_cont(price, q) AS quantile FROM ticks, (VALUES (0.01),(0.05),(0.25),(0.5),(0.75),(0.95),(0.99)) v(q) GROUP BY 1, 2"
       .replace("quantile_cont(price, q)", "CASE " + " ".join(f"WHEN q = {q} THEN quantile_cont(price, {q})" for q in (.01, .05, .25, .5, .75, .95, .99)) + " END"))
def exact_quantiles(t):
    return qt.exact_quantiles(t.ticks, ["symbol"], "price", [.01, .05, .25, .5, .75, .95, .99])


@query("winsorised_mean", "MET11", "symbol:s winsorised_mean median",
       """SELECT symbol, avg(least(greatest(price, lo), hi)) AS winsorised_mean, any_value(m) AS median FROM ticks JOIN (
          SELECT symbol, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi, quantile_cont(price, 0.5) AS m FROM ticks GROUP BY 1) USING (symbol) GROUP BY 1""")
def winsorised_mean(t):
    return mt.winsorised_mean(t.ticks, ["symbol"], "price", 0.05)


CTES["segrows"] = """SELECT *, ((row_idx+1)*5-1)//n AS segment FROM (SELECT p AS x, close AS y, row_idx, (SELECT count(*) FROM preds) AS n FROM preds)"""
CTES["segscores"] = """SELECT segment, CASE WHEN tn >= 20 AND bn >= 20 AND mn >= 20 THEN greatest(abs(tm-mm)+abs(bm-mm)
      - sqrt(2/pi())*sd*(sqrt(1.0/tn+1.0/mn)+sqrt(1.0/bn+1.0/mn)), 0) END AS score FROM (
    SELECT segment, any_value(sd) AS sd, max(CASE WHEN b = 'top' THEN c END) AS tn, max(CASE WHEN b = 'bot' THEN c END) AS bn, max(CASE WHEN b = 'mid' THEN c END) AS mn,
      max(CASE WHEN b = 'top' THEN m END) AS tm, max(CASE WHEN b = 'bot' THEN m END) AS bm, max(CASE WHEN b = 'mid' THEN m END) AS mm FROM (
      SELECT segment, b, any_value(sd) AS sd, count(*) AS c, avg(least(greatest(y, l), h)) AS m FROM (
        SELECT *, quantile_cont(y, 0.01) OVER (PARTITION BY segment, b) AS l, quantile_cont(y, 0.99) OVER (PARTITION BY segment, b) AS h FROM (
          SELECT *, stddev_pop(y) OVER (PARTITION BY segment) AS sd, CASE WHEN x < a1 THEN 'bot' WHEN x > a2 THEN 'top' WHEN x BETWEEN m1 AND m2 THEN 'mid' END AS b
          FROM (SELECT *, segment*n//5 AS s0, (segment+1)*n//5 AS e0 FROM segrows) r JOIN (
            SELECT segment AS sg, quantile_cont(x, 0.2) AS a1, quantile_cont(x, 0.8) AS a2, quantile_cont(x, 0.3) AS m1, quantile_cont(x, 0.7) AS m2
            FROM (SELECT *, segment*n//5 AS s0, (segment+1)*n//5 AS e0 FROM segrows) WHERE row_idx < s0 + floor(0.6*(e0-s0)) GROUP BY 1) q ON r.segment = q.sg
          WHERE row_idx >= s0 + floor(0.6*(e0-s0)) + 10 AND row_idx < e0) WHERE b IS NOT NULL) GROUP BY 1, 2) GROUP BY 1)"""
_SEG = dict(segments=5, train_frac=0.6, gap=10, q_ext=0.2, q_mid=0.2, clip_q=0.01, min_bucket=20)


@query("segment_scores", "MET12 MET14", "segment:i score", "SELECT * FROM segscores")
def segment_scores(t):
    return mt.segment_scores(settle(indexed_preds(t)), "p", "close", **_SEG)


@query("information_ratio", "MET13", "valid:i ir",
       """SELECT count(score) AS valid, CASE WHEN stddev_samp(score) > 0 THEN sum(score*(1+0.5*segment/4.0))/sum(CASE WHEN score IS NOT NULL THEN 1+0.5*segment/4.0 END)/stddev_samp(score) ELSE 0 END AS ir FROM segscores""")
def information_ratio(t):
    return mt.information_ratio(mt.segment_scores(settle(indexed_preds(t)), "p", "close", **_SEG), 5, recency=(1.0, 1.5))


@query("variant_comparison", "MET16", "scope:s metric:s left_value right_value delta winner:s",
       f"""SELECT a.scope, a.metric, a.v AS left_value, b.v AS right_value, b.v-a.v AS delta,
          CASE WHEN abs(b.v-a.v) <= 1e-15 THEN 'tie' WHEN (CASE WHEN a.metric IN ('brier','log_loss') THEN a.v-b.v ELSE b.v-a.v END) > 0 THEN 'right' ELSE 'left' END AS winner
          FROM (UNPIVOT (SELECT scope, {_metric_cols('1.0')} FROM vrows WHERE symbol = 'view' GROUP BY 1) ON {', '.join(mt.METRICS)} INTO NAME metric VALUE v) a
          JOIN (UNPIVOT (SELECT scope, {_metric_cols('1.0')} FROM vrows WHERE symbol = 'click' GROUP BY 1) ON {', '.join(mt.METRICS)} INTO NAME metric VALUE v) b USING (scope, metric)""")
def variant_comparison(t):
    m = settle(mt.metrics_by(mt.scoped(preds(t), "decision"), ["symbol", "scope"]))
    return mt.compare_variants(m.where("symbol='view'"), m.where("symbol='click'"), "scope", mt.METRICS)


CTES["vrows"] = "SELECT *, 'all' AS scope FROM preds UNION ALL SELECT *, 'decision' FROM preds WHERE decision"


@query("variant_summary", "MET17", "symbol:s brier_mean brier_std accuracy_mean accuracy_std",
       "SELECT symbol, avg(brier) AS brier_mean, stddev_pop(brier) AS brier_std, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std FROM fold_metrics GROUP BY 1")
def variant_summary(t):
    return mt.variant_summary(fold_metrics(t), ["symbol"], ["brier", "accuracy"])


# ---- survival ----------------------------------------------------------------------------------

CTES["oof"] = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS side,
    (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = y AS correct, ts + INTERVAL 1 HOUR AS event_time, date_trunc('day', ts + INTERVAL 1 HOUR) AS event_day FROM preds WHERE decision"""
CTES["streaked"] = """SELECT *, CASE WHEN correct THEN count(*) OVER (PARTITION BY symbol, g ORDER BY i DESC) ELSE 0 END AS streak,
      correct AND coalesce(NOT pc, true) AS completed FROM (
    SELECT *, sum(CASE WHEN correct = pc THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS g FROM (
      SELECT *, lag(correct) OVER (PARTITION BY symbol ORDER BY i) AS pc FROM oof))"""


def _streaks(t):
    frame = settle(sv.analysis_frame(preds(t), "decision", HOUR, HOURLY))
    return settle(sv.forward_streaks(frame, HOURLY))


@query("oof_frame", "SRV01", "symbol:s ts:t side:i correct:i event_time:t event_day:t", "SELECT * FROM oof")
def oof_frame(t):
    return sv.analysis_frame(preds(t), "decision", HOUR, HOURLY)


@query("forward_streaks", "SRV02", "symbol:s ts:t streak:i", "SELECT * FROM streaked")
def forward_streaks(t):
    return _streaks(t)


@query("completed_streaks", "SRV03", "symbol:s runs:i mean median p75 p90 p95 p99 max:i",
       """SELECT symbol, count(*) AS runs, avg(streak) AS mean, quantile_cont(streak, 0.5) AS median, quantile_cont(streak, 0.75) AS p75, quantile_cont(streak, 0.9) AS p90,
          quantile_cont(streak, 0.95) AS p95, quantile_cont(streak, 0.99) AS p99, max(streak) AS max FROM streaked WHERE completed GROUP BY 1""")
def completed_streaks(t):
    return sv.completed_stats(_streaks(t), ["symbol"])


@query("survival_table", "SRV04", "symbol:s k:i raw_count:i raw_probability weighted_count weighted_probability",
       """SELECT symbol, k, count_if(streak >= k) AS raw_count, count_if(streak >= k)/count(*)::DOUBLE AS raw_probability,
          sum(CASE WHEN streak >= k THEN w ELSE 0 END) AS weighted_count, sum(CASE WHEN streak >= k THEN w ELSE 0 END)/sum(w) AS weighted_probability
          FROM streaked JOIN (SELECT symbol, unnest(range(1, max(streak)+1)) AS k FROM streaked GROUP BY 1) USING (symbol) GROUP BY 1, 2""")
def survival_table(t):
    return sv.survival(_streaks(t), ["symbol"], "w")


CTES["aged"] = """SELECT s.*, h AS half_life, pow(0.5, date_diff('second', event_time, (SELECT max(event_time) FROM streaked))/86400.0/h) AS hw FROM streaked s, (VALUES (7),(14),(30)) v(h)"""


@query("recency_weights", "SRV05", "half_life:i rows:i weight_sum ess accuracy weighted_accuracy",
       """SELECT half_life, count(*) AS rows, sum(hw) AS weight_sum, sum(hw)*sum(hw)/sum(hw*hw) AS ess, avg(correct::INT) AS accuracy,
          sum(correct::INT*hw)/sum(hw) AS weighted_accuracy FROM aged GROUP BY 1""")
def recency_weights(t):
    return sv.weight_summary(sv.with_recency(_streaks(t), [7, 14, 30]), ["half_life"])


CTES["chosen"] = """SELECT 'half_life' AS kind, half_life AS days, coalesce(max(CASE WHEN pr >= 0.5 THEN k END), 0) AS max_steps FROM (
      SELECT half_life, k, sum(CASE WHEN streak >= k THEN hw ELSE 0 END)/sum(hw) AS pr FROM aged, range(1, 40) r(k) GROUP BY 1, 2) GROUP BY 2
    UNION ALL SELECT 'window', d, coalesce(max(CASE WHEN pr >= 0.5 THEN k END), 0) FROM (
      SELECT d, k, avg((streak >= k)::INT) AS pr FROM streaked, (VALUES (7),(14)) v(d), range(1, 40) r(k)
      WHERE event_time >= (SELECT max(event_time) FROM streaked) - d * INTERVAL 1 DAY GROUP BY 1, 2) GROUP BY 2"""


def _chosen(t):
    s = _streaks(t)
    a = sv.max_steps(sv.survival(sv.with_recency(s.drop("w"), [7, 14, 30]), ["half_life"], "w"), ["half_life"], "weighted_probability")
    b = sv.max_steps(sv.survival(sv.rolling(s, [7, 14]), ["window_days"]), ["window_days"], "raw_probability")
    return (a.select(F.lit("half_life").alias("kind"), F.col("half_life").alias("days"), "max_steps")
            .unionByName(b.select(F.lit("window").alias("kind"), F.col("window_days").alias("days"), "max_steps")))


@query("survival_choices", "SRV06", "kind:s days:i max_steps:i", "SELECT * FROM chosen")
def survival_choices(t):
    return _chosen(t)


@query("oof_summary", "SRV07", "rows:i accuracy days:i per_day_mean per_day_median start:t end:t".replace("start:t end:t", "first_time:t last_time:t"),
       """SELECT sum(c) AS rows, sum(ok)/sum(c)::DOUBLE AS accuracy, count(*) AS days, avg(c) AS per_day_mean, quantile_cont(c, 0.5) AS per_day_median,
          min(lo) AS first_time, max(hi) AS last_time FROM (SELECT event_day, count(*) AS c, count_if(correct) AS ok, min(event_time) AS lo, max(event_time) AS hi FROM oof GROUP BY 1)""")
def oof_summary(t):
    return sv.basic_summary(sv.analysis_frame(preds(t), "decision", HOUR, HOURLY)).withColumnsRenamed({"start": "first_time", "end": "last_time"})


def _scenarios(t):
    s = _streaks(t)
    draws = sv.daily_draws(s, [1, 3], [1, 2, 3], ["symbol"])
    n = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    days = s.select("symbol", "event_day").distinct()
    runs = settle(sv.replay(draws, [1, 2, 3], 0.55, ["symbol"], n))
    return runs, sv.scenario_summary(runs, days, ["symbol"])


@query("daily_draws", "SRV08", "symbol:s event_day:t seed:i starts_per_day:i drawn:i",
       """SELECT symbol, event_day, seed, n AS starts_per_day, least(count(*), n) AS drawn FROM streaked, (VALUES (1),(2)) s(seed), (VALUES (1),(3)) v(n) GROUP BY 1, 2, 3, 4""")
def daily_draws(t):
    return sv.daily_draws(_streaks(t), [1, 3], [1, 2], ["symbol"]).groupBy("symbol", "event_day", "seed", "starts_per_day").agg(
        F.count(F.lit(1)).alias("drawn"))


@query("scenario_replay", "SRV09", "symbol:s starts_per_day:i max_steps:i seed:i run_count:i total_pnl mean_daily median_daily p05_daily max_drawdown losing_days")
def scenario_replay(t):
    return _scenarios(t)[1]


@query("scenario_aggregate", "SRV10", "starts_per_day:i max_steps:i seeds:i mean_total median_total p05_total mean_drawdown best_fraction score")
def scenario_aggregate(t):
    return sv.scenario_aggregate(_scenarios(t)[1]).orderBy(F.col("score").desc(), F.col("mean_total").desc())


@query("step_recommendation", "SRV11", "conservative:i balanced:i",
       """SELECT greatest(1, v[(len(v)-1)//2+1]) AS conservative, greatest(1, CASE WHEN v[len(v)]-v[1] >= 4 THEN least(round_even(m, 0)::INT, greatest(1, floor(q)::INT)) ELSE round_even(m, 0)::INT END) AS balanced
          FROM (SELECT list(max_steps ORDER BY max_steps) AS v, quantile_cont(max_steps, 0.5) AS m, quantile_cont(max_steps, 0.75) AS q FROM chosen WHERE max_steps > 0)""")
def step_recommendation(t):
    return sv.recommend_steps(_chosen(t))


# ---- source comparison ---------------------------------------------------------------------------

CTES["pairs"] = """SELECT c.symbol AS source, r.ts, c.close AS cc, r.close AS rc, c.open AS co, r.open AS ro
    FROM hourly r JOIN hourly c ON r.symbol = 'view' AND c.symbol <> 'view' AND r.ts = c.ts"""


@query("source_differences", "CMP01 CMP02", "source:s rows:i coverage mean_abs_close median_abs_close max_abs_close mean_bps_close match_rate mismatches:i",
       """SELECT source, count(*) AS rows, count(*)/(SELECT count(*) FROM hourly WHERE symbol = 'view')::DOUBLE AS coverage, avg(abs(cc-rc)) AS mean_abs_close,
          quantile_cont(abs(cc-rc), 0.5) AS median_abs_close, max(abs(cc-rc)) AS max_abs_close, avg(abs(cc-rc)/rc*10000) AS mean_bps_close,
          avg(((cc >= co) = (rc >= ro))::INT) AS match_rate, count_if((cc >= co) <> (rc >= ro)) AS mismatches FROM pairs GROUP BY 1""")
def source_differences(t):
    return compare.compare_bars(t.hourly.where("symbol <> 'view'").withColumnRenamed("symbol", "source"), t.hourly.where("symbol = 'view'").drop("symbol"), "source")


@query("source_ranking", "CMP03 CMP05", "source:s rank:i status:s",
       """SELECT s AS source, row_number() OVER (ORDER BY m NULLS LAST, s) AS rank, CASE WHEN m IS NULL THEN 'inactive: known = click,error,purchase,signup' ELSE 'ok' END AS status
          FROM (SELECT DISTINCT event_type AS s FROM events WHERE event_type <> 'view' UNION ALL SELECT DISTINCT o_orderstatus FROM orders) LEFT JOIN (SELECT source, avg(abs(cc-rc)) AS m FROM pairs GROUP BY 1) ON source = s""")
def source_ranking(t):
    stats = source_differences(t)
    wanted = t.raw("events").select(F.col("event_type").alias("source")).where("source <> 'view'").distinct().unionByName(
        t.raw("orders").select(F.col("o_orderstatus").alias("source")).distinct())
    return compare.rank_sources(wanted, stats, "source", "mean_abs_close")


@query("trailing_window", "CMP04", "symbol:s rows:i first_ts:t",
       "SELECT symbol, count(*) AS rows, min(ts) AS first_ts FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS hi FROM hourly) WHERE ts > hi - INTERVAL 3 DAY GROUP BY 1")
def trailing_window(t):
    return compare.trailing(t.hourly, 3 * 86_400, ["symbol"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"))
