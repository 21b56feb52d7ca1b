"""Queries: fees, decisions, back-test, records, positions."""

from pyspark.sql import functions as F

from barloom.operators import policy as po, records as rc
from barloom.plans.base import CTES, HOURLY, query
from barloom.plans.evaluation import preds

FEE = po.Fee(rate=0.07, exponent=1.5, decimals=4, minimum=0.001)


def _frac(p):
    return f"(0.07*pow({p}*(1-{p}), 1.5)/{p})"


def _fee(shares, p):
    return f"(CASE WHEN round_even({shares}*0.07*pow({p}*(1-{p}), 1.5), 4) >= 0.001 THEN round_even({shares}*0.07*pow({p}*(1-{p}), 1.5), 4) ELSE 0 END)"


CTES["quotes"] = """SELECT h.symbol, h.ts, h.open, h.close, p.p AS proba_up, k, 0.2 + (k % 57)/100.0::DOUBLE AS ask_yes, 1.02::DOUBLE - (0.2 + (k % 57)/100.0::DOUBLE) AS ask_no,
    CASE WHEN k % 3 = 0 THEN NULL ELSE 0.01 END AS tick_size FROM (SELECT *, CAST(floor(close*100) AS BIGINT) AS k FROM hourly) h JOIN preds p ON h.symbol = p.symbol AND h.ts = p.ts"""


def quotes(t):
    k = F.floor(F.col("close") * 100)
    h = t.hourly.withColumn("k", k).select("symbol", "ts", "open", "close", "k")
    d = h.join(preds(t).select("symbol", "ts", F.col("p").alias("proba_up")), ["symbol", "ts"])
    return d.withColumn("ask_yes", F.lit(0.2) + (F.col("k") % 57) / 100.0).withColumns(
        {"ask_no": F.lit(1.02) - F.col("ask_yes"), "tick_size": F.when(F.col("k") % 3 != 0, 0.01)})


@query("row_medians", "POL01", "symbol:s ts:t median", "SELECT symbol, ts, list_median([open, close, CASE WHEN volume > 200 THEN high END]) AS median FROM hourly".replace("list_median(", "list_aggregate(").replace("END])", "END], 'median')"))
def row_medians(t):
    return t.hourly.withColumn("median", po.median_of(["open", "close", F.when(F.col("volume") > 200, F.col("high"))]))


@query("bucket_medians", "POL02 POL03", "symbol:s day:t price size observations:i",
       "SELECT symbol, date_trunc('day', ts) AS day, quantile_cont(price, 0.5) AS price, quantile_cont(size, 0.5) AS size, count(*) AS observations FROM ticks GROUP BY 1, 2")
def bucket_medians(t):
    return po.bucket_medians(t.ticks.withColumn("day", F.date_trunc("day", "ts")), ["symbol", "day"], ["price", "size"])


CTES["btframe"] = """SELECT *, CASE WHEN tick_size > 0 THEN tick_size ELSE 0.01 END AS tick, CASE WHEN close > open THEN 1 ELSE 0 END AS actual_up FROM quotes
    WHERE proba_up BETWEEN 0 AND 1 AND open > 0 AND close > 0 AND ask_yes > 0 AND ask_yes < 1 AND ask_no > 0 AND ask_no < 1"""


def _frame(t):
    q = quotes(t)
    probs = po.clean_probabilities(q, ["symbol", "ts"], "proba_up")
    return po.backtest_frame(probs, q.drop("proba_up"), ["symbol", "ts"])


@query("backtest_frame", "POL03 POL04", "symbol:s ts:t proba_up ask_yes ask_no tick actual_up:i", "SELECT * FROM btframe")
def backtest_frame(t):
    return _frame(t).withColumn("tick", F.col("tick_size"))


@query("fee_columns", "POL05", "symbol:s ts:t frac fee_shares fee_notional",
       f"SELECT symbol, ts, {_frac('ask_yes')} AS frac, {_fee('12.0', 'ask_yes')} AS fee_shares, {_fee('(3.0/ask_yes)', 'ask_yes')} AS fee_notional FROM quotes")
def fee_columns(t):
    return quotes(t).withColumns({"frac": FEE.fraction("ask_yes"), "fee_shares": FEE.from_shares(F.lit(12.0), "ask_yes"),
                                  "fee_notional": FEE.from_notional(F.lit(3.0), "ask_yes")})


CTES["evs"] = f"""SELECT *, CASE WHEN abs(e1) <= 1e-12 THEN 0 ELSE e1 END AS ev_yes, CASE WHEN abs(e2) <= 1e-12 THEN 0 ELSE e2 END AS ev_no FROM (
    SELECT *, proba_up - ask_yes - {_frac('ask_yes')} - 0.01 AS e1, (1-proba_up) - ask_no - {_frac('ask_no')} - 0.01 AS e2 FROM btframe)"""
CTES["decided"] = """SELECT *, CASE WHEN ev_yes <= 0 AND ev_no <= 0 THEN 'no_trade' WHEN ev_yes > ev_no + 1e-12 THEN 'buy_yes' ELSE 'buy_no' END AS decision,
    CASE WHEN ev_yes <= 0 AND ev_no <= 0 THEN 'no_positive_ev' WHEN ev_yes > ev_no + 1e-12 THEN 'yes_ev_gt_no_ev' ELSE 'no_ev_gte_yes_ev' END AS reason FROM evs"""


def _decided(t):
    d = _frame(t).withColumns({"fee_yes": FEE.fraction("ask_yes"), "fee_no": FEE.fraction("ask_no")})
    return po.ev_decision(d, 0.01)


@query("ev_decision", "POL06", "symbol:s ts:t ev_yes ev_no decision:s reason:s", "SELECT * FROM decided")
def ev_decision(t):
    return _decided(t)


@query("ev_missing_inputs", "POL06", "symbol:s ts:t decision:s reason:s",
       f"""SELECT symbol, ts, 'no_trade' AS decision, 'missing_policy_input:' || CASE WHEN k % 3 = 0 THEN 'ask_yes' ELSE 'ask_no_out_of_range' END AS reason FROM quotes WHERE ask_no > 0""")
def ev_missing_inputs(t):
    d = quotes(t).where("ask_no > 0").withColumns({"fee_yes": F.lit(0.0), "fee_no": F.lit(0.0)})
    d = d.withColumns({"ask_yes": F.when(F.col("k") % 3 != 0, F.col("ask_yes")), "ask_no": F.when(F.col("k") % 3 != 0, F.lit(1.5)).otherwise(F.lit(0.4))})
    return po.ev_decision(d, 0.01)


@query("threshold_decision", "POL07", "symbol:s ts:t decision:s reason:s",
       """SELECT symbol, ts, CASE WHEN m < CASE WHEN proba_up >= 0.55 THEN 0.1 ELSE 0.05 END THEN 'no_trade' WHEN proba_up >= 0.55 THEN 'buy_yes' ELSE 'buy_no' END AS decision,
          CASE WHEN m < CASE WHEN proba_up >= 0.55 THEN 0.1 ELSE 0.05 END THEN 'below_min_decision_margin' ELSE 'model_direction_threshold' END AS reason
          FROM (SELECT *, CASE WHEN proba_up >= 0.55 THEN proba_up-0.55::DOUBLE ELSE 0.55::DOUBLE-proba_up END AS m FROM quotes)""")
def threshold_decision(t):
    return po.threshold_decision(quotes(t), 0.55, margin=0.05, margin_up=0.1)


@query("submitted_price", "POL08", "symbol:s ts:t price error:s",
       """SELECT symbol, ts, CASE WHEN ask_yes <= 0.7 + 1e-12 THEN round_even(least(ask_yes + 3*tick, 0.7), 4) END AS price,
          CASE WHEN ask_yes > 0.7 + 1e-12 THEN 'entry_price_above_order_price_cap' ELSE '' END AS error FROM btframe""")
def submitted_price(t):
    price, error = po.submitted_price("ask_yes", F.lit(0.7), "entry_price_plus_ticks", "tick_size", 3)
    return _frame(t).withColumns({"price": price, "error": error})


def _stake_sql(price, shares="5.0"):
    g = f"(ceil({shares}*{price}/greatest(1-{_frac(price)},1e-12)*100 - 1e-12)/100)"
    s = "(ceil((g + s*0.01)*100 - 1e-12)/100)"
    return g, s


@query("minimum_stake", "POL09", "symbol:s ts:t stake:d4 met:i",
       f"""SELECT symbol, ts, coalesce(min(st) FILTER (ok AND s < 8), max(st)) AS stake, bool_or(ok) AS met FROM (
            SELECT *, (st - {_fee('(st/ask_yes)', 'ask_yes')})/ask_yes + 1e-12 >= 5 AS ok FROM (SELECT symbol, ts, ask_yes, s, ceil((g + s*0.01::DOUBLE)*100 - 1e-12)/100 AS st FROM (
            SELECT symbol, ts, ask_yes, {_stake_sql('ask_yes')[0]} AS g FROM btframe), range(0, 9) r(s))) GROUP BY 1, 2""")
def minimum_stake(t):
    d = _frame(t).withColumn("stake", po.minimum_stake("ask_yes", FEE, F.lit(5.0)))
    return d.withColumn("met", po.stake_met("stake", "ask_yes", FEE, F.lit(5.0)))


CTES["staked"] = f"""SELECT symbol, ts, any_value(decision) AS decision, any_value(reason) AS reason, any_value(e) AS e, coalesce(min(CASE WHEN s < 8 AND (st - {_fee('(st/e)', 'e')})/e + 1e-12 >= 5 THEN st END), max(st)) AS req FROM (
    SELECT *, ceil((g + s*0.01::DOUBLE)*100 - 1e-12)/100 AS st FROM (SELECT *, {_stake_sql('e')[0]} AS g FROM (
      SELECT *, CASE decision WHEN 'buy_yes' THEN ask_yes WHEN 'buy_no' THEN ask_no END AS e FROM decided)), range(0, 9) r(s)) GROUP BY 1, 2"""


@query("trade_intent", "POL10", "symbol:s ts:t decision:s trade_side:s bet:d4 final_reason:s",
       f"""SELECT symbol, ts, CASE WHEN fr = 'ok' THEN decision ELSE 'no_trade' END AS decision, CASE WHEN fr = 'ok' THEN CASE decision WHEN 'buy_yes' THEN 'yes' ELSE 'no' END ELSE 'none' END AS trade_side,
          CASE WHEN fr = 'ok' THEN stake ELSE 0 END AS bet, fr AS final_reason FROM (SELECT *, CASE WHEN decision = 'no_trade' THEN reason WHEN stake > 6 THEN 'stake_above_bankroll'
            WHEN stake > 5 THEN 'stake_above_external_cap' WHEN (stake - {_fee('(stake/e)', 'e')})/e < 5 THEN 'shares_below_order_min' ELSE 'ok' END AS fr FROM (SELECT *, req*2 AS stake FROM staked))""")
def trade_intent(t):
    return po.trade_intent(_decided(t), FEE, bankroll=F.lit(6.0), multiplier=F.lit(2.0), min_shares=F.lit(5.0), cap=F.lit(5.0))


CTES["trades"] = f"""SELECT *, row_number() OVER (PARTITION BY symbol, b ORDER BY ts) AS n, CASE WHEN skip = '' THEN win::INT END AS is_win,
      CASE WHEN skip = '' THEN (CASE WHEN win THEN (price - {_fee('1.0', 'price')})/price ELSE 0 END) - price END AS pnl FROM (
    SELECT *, CASE WHEN d2 = 'no_trade' THEN 'no_trade' WHEN e > 0.75 + 1e-12 THEN 'submission' ELSE '' END AS skip,
      CASE WHEN d2 <> 'no_trade' AND e <= 0.75 + 1e-12 THEN round_even(least(e + 2*tick, 0.75), 4) END AS price,
      CASE WHEN d2 = 'buy_yes' THEN actual_up = 1 ELSE actual_up = 0 END AS win FROM (
      SELECT *, CASE d2 WHEN 'buy_yes' THEN ask_yes WHEN 'buy_no' THEN ask_no END AS e FROM (
        SELECT *, CASE WHEN y <= 0 AND m <= 0 THEN 'no_trade' WHEN y > m + 1e-12 THEN 'buy_yes' ELSE 'buy_no' END AS d2 FROM (
          SELECT *, e1 + 0.01 - b AS y, e2 + 0.01 - b AS m FROM evs, (VALUES (0.0::DOUBLE), (0.02), (0.05)) v(b)))))"""
CTES["replayed"] = """SELECT symbol, b AS buffer, count(*) AS row_count, count(pnl) AS executed, avg(is_win) AS win_rate, coalesce(sum(pnl), 0) AS total_profit, sum(price) AS total_stake,
      stddev_samp(pnl) AS std_pnl, avg(pnl/price) AS mean_return, sqrt(avg(CASE WHEN pnl IS NOT NULL THEN pow(least(pnl/price, 0), 2) END)) AS downside, max(CASE WHEN skip = '' THEN peak - cum END) AS max_drawdown,
      count_if(skip = 'submission') AS skipped_submission, coalesce(sum(pnl), 0)/greatest(sqrt(avg(CASE WHEN pnl IS NOT NULL THEN pow(least(pnl/price, 0), 2) END)), 1e-9) AS objective FROM (
    SELECT *, greatest(max(cum) OVER (PARTITION BY symbol, b ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS peak FROM (
      SELECT *, sum(coalesce(pnl, 0)) OVER (PARTITION BY symbol, b ORDER BY n ROWS UNBOUNDED PRECEDING) AS cum FROM trades)) GROUP BY 1, 2"""


def _scan(t):
    return po.scan_buffers(_frame(t), FEE, [0.0, 0.02, 0.05], HOURLY, price_cap=0.75, price_mode="entry_price_plus_ticks", ticks=2)


@query("policy_replay", "POL11 POL12", "symbol:s buffer row_count:i executed:i win_rate total_profit total_stake std_pnl mean_return downside max_drawdown skipped_submission:i objective:d4",
       "SELECT * FROM replayed")
def policy_replay(t):
    return _scan(t)


@query("best_buffer", "POL12", "symbol:s buffer objective:d4", "SELECT symbol, buffer, objective FROM replayed QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(objective, 10) DESC, buffer) = 1")
def best_buffer(t):
    return po.best_candidate(_scan(t), ["symbol"])


@query("market_fees", "POL13", "event_id:i fee_status:s fee_rate fee_exponent fee_decimals:i",
       """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'disabled' WHEN event_id % 3 = 1 THEN 'schedule' ELSE 'invalid' END AS fee_status,
          CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN price/1000 END AS fee_rate, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS fee_exponent,
          CASE event_id % 3 WHEN 1 THEN 3 ELSE 5 END AS fee_decimals FROM ticks""")
def market_fees(t):
    sched = F.struct((F.col("price") / 1000).alias("rate"), F.lit(2.0).alias("exponent"), F.lit(3).alias("fee_round_decimals"))
    k = F.col("event_id") % 3
    body = F.to_json(F.struct((k != 0).alias("feesEnabled"), F.when(k == 1, sched).alias("feeSchedule")))
    return po.fee_from_market(t.ticks.withColumn("market", body), "market")


@query("bet_gate", "POL14", "symbol:s ts:t gate_reason:s bet:d4",
       f"""SELECT symbol, ts, gr AS gate_reason, CASE WHEN gr = 'ok' THEN req*2 ELSE 0 END AS bet FROM (
          SELECT s.symbol, s.ts, req, CASE WHEN k % 5 = 0 THEN 'market_not_accepting' WHEN k % 100 < 30 THEN 'too_close_to_end' WHEN decision = 'no_trade' THEN reason
            WHEN req*2 > 6 THEN 'stake_above_bankroll' WHEN req*2 > 5 THEN 'stake_above_external_cap' WHEN (req*2 - {_fee('(req*2/e)', 'e')})/e < 5 THEN 'shares_below_order_min'
            WHEN e > 0.7 + 1e-12 THEN 'entry_price_above_order_price_cap' ELSE 'ok' END AS gr FROM staked s JOIN quotes q ON s.symbol = q.symbol AND s.ts = q.ts)""")
def bet_gate(t):
    d = _frame(t).withColumns({"accepting": F.col("k") % 5 != 0, "seconds_to_close": F.col("k") % 100})
    return po.recommendation(d, FEE, policy="ev", threshold=0.5, buffer=0.01, bankroll=F.lit(6.0), multiplier=F.lit(2.0), min_shares=F.lit(5.0),
                             min_seconds=30, cap=F.lit(5.0), price_cap=0.7, price_mode="entry_price_plus_ticks", ticks=1)


# ---- records ---------------------------------------------------------------------------------------

CTES["recs"] = """SELECT symbol, ts, k, proba_up, CAST(k % 7 AS INT) AS m, symbol || ':' || k AS asset, CASE WHEN k % 7 < 5 THEN CASE WHEN close > open THEN 1 ELSE 0 END END AS actual_up,
    CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'none' END AS trade_side, CASE WHEN k % 5 = 0 THEN NULL ELSE ask_yes*10 END AS stake, 10.0 + k % 3 AS shares_net,
    CASE WHEN k % 6 = 0 THEN 'closed' ELSE 'pending' END AS status FROM quotes"""


def records(t):
    q, k = quotes(t), F.col("k")
    return q.select("symbol", "ts", "k", "proba_up", (k % 7).cast("int").alias("m"), F.concat("symbol", F.lit(":"), k).alias("asset"),
                    F.when(k % 7 < 5, (F.col("close") > F.col("open")).cast("int")).alias("actual_up"),
                    F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no").when(k % 4 == 2, "yes").otherwise("none").alias("trade_side"),
                    F.when(k % 5 != 0, F.col("ask_yes") * 10).alias("stake"), (F.lit(10.0) + k % 3).alias("shares_net"),
                    F.when(k % 6 == 0, "closed").otherwise("pending").alias("status"))


@query("record_ids", "STR12", "symbol:s ts:t id:s",
       """SELECT symbol, ts, CASE m WHEN 0 THEN 'own-' || k WHEN 1 THEN 'bucket:' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN 'external:' || asset
          WHEN 3 THEN 'prediction:' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS id FROM recs""")
def record_ids(t):
    m = F.col("m")
    ident = rc.stable_id(F.when(m == 0, F.concat(F.lit("own-"), "k")), F.when(m == 1, F.col("ts")), F.when(m == 2, F.col("asset")), F.when(m == 3, F.col("ts")))
    return records(t).withColumn("id", ident)


@query("record_price_backfill", "LIV01", "symbol:s bucket_start:t bucket_open bucket_close",
       """SELECT r.symbol, r.ts AS bucket_start, CASE WHEN k % 2 = 0 THEN -1 ELSE o.open END AS bucket_open, c.close AS bucket_close FROM recs r
          LEFT JOIN hourly o ON o.symbol = r.symbol AND o.ts = r.ts LEFT JOIN hourly c ON c.symbol = r.symbol AND c.ts = r.ts + INTERVAL 3 HOUR""")
def record_price_backfill(t):
    r = records(t).select("symbol", F.col("ts").alias("bucket_start"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("bucket_last"),
                          F.when(F.col("k") % 2 == 0, -1.0).alias("bucket_open"), F.lit(None).cast("double").alias("bucket_close"))
    return rc.backfill_prices(r, t.hourly, ["symbol"])


@query("market_outcomes", "LIV02", "event_id:i actual_up:i",
       """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN price > 10 THEN 1 ELSE 0 END WHEN 3 THEN NULL ELSE NULL END AS actual_up FROM ticks WHERE price <> 10""")
def market_outcomes(t):
    """Open markets quote strictly between zero and one, above a half where the price is above 10."""
    m, above = F.col("event_id") % 5, F.col("price") - 10
    frac = 0.5 + 0.49 * above / (F.abs(above) + 20)
    prices = F.when(m == 1, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(frac.cast("string"), (1 - frac).cast("string")))
    body = F.to_json(F.struct(F.when(m == 0, "Up").alias("winning_outcome"), F.when(m == 2, "resolved").otherwise("proposed").alias("umaResolutionStatus"),
                              F.array(F.lit("Up"), F.lit("Down")).alias("outcomes"), prices.alias("outcomePrices")))
    return rc.market_outcome(t.ticks.where("price <> 10").withColumn("market", body), "market")


CTES["judged"] = """SELECT *, CASE trade_side WHEN 'yes' THEN (actual_up = 1)::INT WHEN 'no' THEN (actual_up = 0)::INT END AS is_correct,
    CASE WHEN proba_up >= 0.5 THEN (actual_up = 1)::INT ELSE (actual_up = 0)::INT END AS model_correct FROM recs"""


@query("record_accuracy", "LIV03", "symbol:s ts:t is_correct:i model_side:s model_correct:i", "SELECT *, CASE WHEN proba_up >= 0.5 THEN 'up' ELSE 'down' END AS model_side FROM judged")
def record_accuracy(t):
    return records(t).withColumns({"is_correct": rc.side_correct("trade_side", "actual_up"), "model_side": rc.model_side("proba_up"),
                                   "model_correct": rc.model_correct("proba_up", "actual_up")})


@query("running_win_rates", "LIV04", "symbol:s ts:t policy_rate trade_rate",
       """SELECT symbol, ts, CASE WHEN actual_up IS NOT NULL THEN sum(CASE WHEN actual_up IS NOT NULL THEN coalesce(is_correct, 0) END) OVER w / count(actual_up) OVER w::DOUBLE END AS policy_rate,
          CASE WHEN actual_up IS NOT NULL AND count(CASE WHEN trade_side <> 'none' THEN actual_up END) OVER w > 0 THEN
            sum(CASE WHEN actual_up IS NOT NULL AND trade_side <> 'none' THEN is_correct END) OVER w / (count(CASE WHEN trade_side <> 'none' THEN actual_up END) OVER w)::DOUBLE END AS trade_rate
          FROM judged WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""".replace("count(actual_up) OVER w::DOUBLE", "(count(actual_up) OVER w)::DOUBLE"))
def running_win_rates(t):
    d = records(t).withColumn("is_correct", rc.side_correct("trade_side", "actual_up"))
    d = d.withColumns({"trade_is_win": F.col("is_correct"), "resolved": F.col("actual_up").isNotNull(), "traded": F.col("trade_side") != "none"})
    return rc.running_win_rates(d, "resolved", "traded", HOURLY)


CTES["settled"] = """SELECT *, CASE WHEN is_correct IS NOT NULL AND stake IS NOT NULL THEN CASE WHEN is_correct = 1 THEN shares_net ELSE 0 END END AS payout,
    CASE WHEN is_correct IS NOT NULL AND stake IS NOT NULL THEN CASE WHEN is_correct = 1 THEN shares_net ELSE 0 END - stake END AS pnl FROM judged"""


@query("record_settlement", "LIV06 LIV08", "symbol:s ts:t payout pnl trade_is_win:i payout_source:s",
       "SELECT *, (pnl > 0)::INT AS trade_is_win, CASE WHEN pnl IS NOT NULL THEN 'settlement_outcome_shares' ELSE 'data_api_closed_positions' END AS payout_source FROM settled")
def record_settlement(t):
    r = records(t)
    pending = r.withColumns({"actual_up": F.lit(None).cast("int"), "pnl": F.lit(None).cast("double")})
    return rc.local_outcome_pnl(pending, r.select("symbol", "ts", "actual_up"), ["symbol", "ts"])


@query("record_statistics", "LIV05", "symbol:s records:i resolved:i trades:i closed:i open_trades:i policy_win_rate closed_pnl pending_pnl staked",
       """SELECT symbol, count(*) AS records, count(actual_up) AS resolved, count_if(trade_side <> 'none') AS trades, count_if(status = 'closed') AS closed,
          count_if(trade_side <> 'none' AND status <> 'closed') AS open_trades, avg(CASE WHEN actual_up IS NOT NULL THEN is_correct END) AS policy_win_rate,
          coalesce(sum(CASE WHEN status = 'closed' THEN pnl END), 0) AS closed_pnl, coalesce(sum(CASE WHEN trade_side <> 'none' AND status <> 'closed' THEN pnl END), 0) AS pending_pnl,
          coalesce(sum(CASE WHEN trade_side <> 'none' THEN stake END), 0) AS staked FROM settled GROUP BY 1""")
def record_statistics(t):
    d = rc.settle_records(records(t).withColumn("is_correct", rc.side_correct("trade_side", "actual_up")))
    return rc.record_statistics(d, ["symbol"]).withColumnRenamed("open", "open_trades")


@query("order_fills", "LIV07", "event_id:i filled_shares filled_stake fill_price fill_source:s",
       """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN size ELSE price END AS filled_shares, CASE WHEN event_id % 2 = 0 THEN size/2 ELSE 1 END AS filled_stake,
          CASE WHEN event_id % 2 = 0 THEN CASE WHEN size > 0 THEN 0.5 END ELSE 1/price END AS fill_price, CASE WHEN event_id % 2 = 0 THEN 'response' ELSE 'requested' END AS fill_source FROM ticks""")
def order_fills(t):
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("size").alias("takingAmount"), (F.col("size") / 2).alias("makingAmount")))).otherwise("{}")
    return rc.fill_fields(t.ticks.withColumns({"response": body, "requested_shares": F.col("price"), "requested_stake": F.lit(1.0)}), "response")


CTES["closedpos"] = "SELECT asset, max(ts) AS closed_at, arg_max(k, ts) % 9 + 1.0 AS shares, arg_max(proba_up, ts) - 0.5 AS realized_pnl FROM recs WHERE k % 3 = 0 GROUP BY 1"


@query("record_reconciliation", "LIV09", "symbol:s ts:t status:s pnl entry_shares",
       """SELECT r.symbol, r.ts, CASE WHEN c.asset IS NOT NULL THEN 'closed' WHEN r.k % 3 = 1 THEN 'open' ELSE r.status END AS status,
          CASE WHEN c.asset IS NOT NULL THEN CASE WHEN is_correct IS NOT NULL AND stake IS NOT NULL THEN CASE WHEN is_correct = 1 THEN c.shares ELSE 0 END - stake ELSE c.realized_pnl END END AS pnl,
          CASE WHEN r.k % 3 = 1 THEN 4.0 END AS entry_shares FROM judged r LEFT JOIN closedpos c ON r.asset = c.asset""")
def record_reconciliation(t):
    r = records(t)
    k = F.col("k")
    closed = r.where(k % 3 == 0).select("asset", F.col("ts").alias("closed_at"), F.lit(0).alias("row_id"), (k % 9 + 1.0).alias("shares"),
                                        (F.col("proba_up") - 0.5).alias("realized_pnl"), F.lit(None).cast("double").alias("avg_price"))
    opened = r.where(k % 3 == 1).select("asset", F.lit(4.0).alias("size"), F.lit(0.4).alias("avg_price"))
    base = r.withColumns({"entry_shares": F.lit(None).cast("double"), "entry_price": F.lit(None).cast("double")})
    return rc.reconcile(base, closed, opened)


@query("redeem_candidates", "LIV10", "position_id:i reason:s action:s", """WITH pos AS (SELECT event_id AS position_id, event_id % 400 AS c, event_id % 41 = 0 AS unnamed, event_id % 800 AS asset,
      event_id % 7 <> 0 AS redeemable, event_id % 31 = 0 AS negative FROM ticks WHERE event_id % 5 <> 0),
    rec AS (SELECT event_id % 400 AS c, event_id % 800 AS asset, event_id % 3 <> 0 AS resolved, event_id % 4 = 0 AS won, event_id % 11 = 0 AS submitted FROM ticks WHERE event_id % 2 = 0),
    cond AS (SELECT c, bool_or(resolved) AS resolved, bool_or(won) AS won FROM rec GROUP BY 1), hit AS (SELECT c, asset, bool_or(submitted) AS submitted FROM rec WHERE won GROUP BY 1, 2),
    coded AS (SELECT p.*, CASE WHEN unnamed THEN 'missing_condition_id' WHEN negative THEN 'negative_risk_unsupported' WHEN cond.c IS NULL THEN 'untracked_condition' WHEN NOT cond.resolved THEN 'unresolved_local_state'
        WHEN NOT cond.won THEN 'local_outcome_not_winning' WHEN hit.c IS NULL THEN 'position_asset_not_winning_record' WHEN hit.submitted THEN 'already_redeem_submitted'
        WHEN NOT redeemable THEN 'not_redeemable' ELSE 'eligible' END AS why FROM pos p LEFT JOIN cond ON cond.c = p.c AND NOT unnamed LEFT JOIN hit ON hit.c = p.c AND hit.asset = p.asset AND NOT unnamed),
    ends AS (SELECT CASE WHEN unnamed THEN -1 ELSE c END AS g, min(position_id) AS first_id, arg_min(why = 'eligible', position_id) AS accepted FROM coded
        WHERE why IN ('eligible', 'negative_risk_unsupported', 'local_outcome_not_winning', 'already_redeem_submitted') GROUP BY 1),
    final AS (SELECT position_id, CASE WHEN why <> 'missing_condition_id' AND position_id > first_id THEN CASE WHEN accepted THEN 'duplicate_condition_id' ELSE 'condition_already_blocked' END ELSE why END AS reason
        FROM coded LEFT JOIN ends ON g = CASE WHEN unnamed THEN -1 ELSE c END)
    SELECT position_id, reason, CASE WHEN reason = 'eligible' THEN 'candidate' ELSE 'skip' END AS action FROM final""")
def redeem_candidates(t):
    e = t.ticks
    k = F.col("event_id")
    cond = F.concat(F.lit("0x"), F.lpad((k % 400).cast("string"), 64, "0"))
    pos = e.select(k.alias("position_id"), F.when(k % 41 == 0, "").otherwise(cond).alias("condition_id"), F.concat(F.lit("a"), k % 800).alias("asset"),
                   (k % 7 != 0).alias("redeemable"), (k % 31 == 0).alias("negative_risk"), F.when(k % 5 == 0, "other").otherwise("btc-up-5m").alias("slug"))
    recs = e.where(k % 2 == 0).select(F.lit("live").alias("mode"), cond.alias("condition_id"), F.concat(F.lit("a"), k % 800).alias("asset"),
                                      (k % 3 != 0).alias("resolved"), (k % 4 == 0).alias("won"), F.when(k % 11 == 0, "redeem_submitted").otherwise("pending").alias("status"))
    return rc.redeem_candidates(pos, recs, "btc-up")


@query("exit_candidates", "LIV11", "asset:s pnl roi redeem_pnl",
       f"""SELECT asset, pnl, pnl/stake AS roi, size - stake AS redeem_pnl FROM (SELECT asset, stake, size, secs, size*bid - {_fee('size', 'bid')} - stake AS pnl FROM (
          SELECT 'a' || event_id AS asset, 1.0 + event_id % 3 AS stake, size, event_id % 90 AS secs, 0.05 + (event_id % 90)/101.7::DOUBLE AS bid FROM ticks WHERE event_id % 4 <> 0 AND event_id % 6 <> 0 AND size > 0))
          WHERE (size - stake <= 0 OR pnl >= 0.7*(size - stake)) AND secs > 10 AND pnl >= 0.1 AND pnl/stake >= 0.05""")
def exit_candidates(t):
    k = F.col("event_id")
    a = F.concat(F.lit("a"), k).alias("asset")
    pos = t.ticks.select(a, "size")
    recs = t.ticks.select(a, F.lit("live").alias("mode"), (F.lit(1.0) + k % 3).alias("stake"), (k % 90).alias("seconds_to_close"),
                          F.when(k % 4 == 0, 1).alias("actual_up"), F.when(k % 6 == 0, "closed").alias("status"))
    books = t.ticks.select(a, (F.lit(0.05) + (k % 90) / 101.7).alias("best_bid"))
    return rc.exit_candidates(pos, recs, books, FEE, tolerance=0.3, min_seconds=10, min_profit=0.1, min_roi=0.05)


def _books(t):
    lv = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.floor(F.col("price")) + i % 2).alias("price"), (F.col("size") + i).alias("size")))
    return t.ticks.select(F.concat(F.lit("t"), F.col("event_id")).alias("asset"), lv.alias("bids"), lv.alias("asks"))


@query("book_best_levels", "LIV12", "asset:s best_ask ask_size best_bid bid_size",
       "SELECT 't' || event_id AS asset, floor(price) AS best_ask, 2*size + 2 AS ask_size, floor(price) + 1 AS best_bid, 2*size + 4 AS bid_size FROM ticks")
def book_best_levels(t):
    a, b = rc.best_level("asks", "ask"), rc.best_level("bids", "bid")
    return _books(t).withColumns({"best_ask": a[0], "ask_size": a[1], "best_bid": b[0], "bid_size": b[1]})


@query("slug_filter", "LIV13", "slug:s hit:i", "SELECT slug, slug = 'v' OR slug LIKE 'v-%' AS hit FROM (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'v-' || user_id ELSE 'vx-' || user_id END AS slug FROM events)")
def slug_filter(t):
    k = F.col("event_id") % 3
    slug = F.when(k == 0, "v").when(k == 1, F.concat(F.lit("v-"), "user_id")).otherwise(F.concat(F.lit("vx-"), "user_id"))
    return t.raw("events").select(slug.alias("slug")).distinct().withColumn("hit", rc.slug_matches("slug", "v"))


@query("market_snapshot", "LIV14", "event_id:i token:s outcome:s tick_size best_bid best_ask",
       """SELECT k.event_id, 't' || j AS token, CASE WHEN j = k.event_id THEN 'Up' ELSE 'Down' END AS outcome, CASE WHEN k.event_id % 2 = 0 THEN 0.001 ELSE 0.01 END AS tick_size,
          floor(b.price) + 1 AS best_bid, floor(b.price) AS best_ask FROM ticks k, (VALUES (0), (1)) v(o), LATERAL (SELECT k.event_id + o AS j) LEFT JOIN ticks b ON b.event_id = j""")
def market_snapshot(t):
    k = F.col("event_id")
    body = F.to_json(F.struct(F.array(F.concat(F.lit("t"), k), F.concat(F.lit("t"), k + 1)).alias("clobTokenIds"), F.array(F.lit("Up"), F.lit("Down")).alias("outcomes"),
                              F.when(k % 2 == 0, 0.001).alias("tickSize")))
    return rc.market_snapshot(t.ticks.select("event_id", body.alias("market")), "market", _books(t))


@query("external_records", "LIV15", "asset:s record_id:s status:s", "SELECT DISTINCT 'u' || user_id AS asset, 'external:u' || user_id AS record_id, 'open' AS status FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 40)")
def external_records(t):
    e = t.raw("events").withColumn("asset", F.concat(F.lit("u"), "user_id"))
    return rc.external_records(e.select("asset").distinct(), e.where("event_type = 'view' AND value > 40"))
