"""Fees, trade decisions, submitted prices, stakes, and back-test replay as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import col
from barloom.operators.oneway import TIE_DIGITS
from barloom.operators.ordered import Layout, running, settle
from barloom.operators.quantiles import quantile_columns

# Fixed values of the decision rules.
EPS = 1e-12
HOT_ROWS = 1_000_000                # rows of a bucket that one aggregate may hold
TICK_FALLBACK = 0.01
STAKE_DECIMALS = 2
ADJUST_STEPS = 8
DOWNSIDE_EPS = 1e-9
NO_TRADE_OBJECTIVE = -1e9


@dataclass(frozen=True)
class Fee:
    """Fee of ``rate * (p (1 - p))^exponent`` per share."""

    rate: float = 0.0
    exponent: float = 1.0
    decimals: int = 5
    minimum: float = 0.00001

    def curve(self, price) -> Column:
        p = col(price)
        return F.when((p > 0) & (p < 1), F.pow(p * (1 - p), F.lit(self.exponent)))

    def fraction(self, price) -> Column:
        """Fee as a share of the notional."""
        return self.curve(price) * self.rate / col(price)

    def from_shares(self, shares, price) -> Column:
        raw = col(shares) * self.rate * self.curve(price)
        fee = F.bround(raw, self.decimals)
        return F.when((col(shares) > 0) & (fee >= self.minimum), fee).otherwise(0.0)

    def from_notional(self, notional, price) -> Column:
        return self.from_shares(col(notional) / col(price), price)


def fee_from_market(df: DataFrame, payload: str, decimals: int = 5, minimum: float = 0.00001) -> DataFrame:
    """Fee fields of a market JSON: disabled is free; an enabled market must carry a valid schedule."""
    schema = "feesEnabled boolean, feeSchedule struct<rate:double, exponent:double, fee_round_decimals:int, min_fee:double>"
    m = F.from_json(F.col(payload), schema)
    on, s = F.coalesce(m["feesEnabled"], F.lit(False)), m["feeSchedule"]
    bad = on & (s.isNull() | s["rate"].isNull() | (s["rate"] < 0) | (F.coalesce(s["exponent"], F.lit(1.0)) <= 0))
    return df.withColumns({
        "fee_status": F.when(bad, "invalid").when(on, "schedule").otherwise("disabled"),
        "fee_rate": F.when(bad, None).when(on, s["rate"]).otherwise(0.0),
        "fee_exponent": F.when(bad, None).when(on, F.coalesce(s["exponent"], F.lit(1.0))).otherwise(1.0),
        "fee_decimals": F.when(on & ~bad, F.coalesce(s["fee_round_decimals"], F.lit(decimals))).otherwise(decimals),
        "fee_minimum": F.when(on & ~bad, F.coalesce(s["min_fee"], F.lit(minimum))).otherwise(minimum)})


# ---- prices per bucket -------------------------------------------------------------------------

def median_of(cols: list) -> Column:
    """Median of the non-null values of several columns of one row."""
    v = F.array_sort(F.array_compact(F.array(*[col(c) for c in cols])))
    n = F.size(v)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.try_element_at(v, mid + 1)).otherwise(
        (F.try_element_at(v, mid) + F.try_element_at(v, mid + 1)) / 2)


def bucket_medians(df: DataFrame, key: list[str], cols: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median of each column per bucket and the observation count.

    A bucket of up to ``hot_rows`` rows is one aggregate.  Of larger ones, counts of value ranges find the range that holds the
    middle, and only its rows are ordered, so no task holds the values of a hot bucket.
    """
    sizes = settle(df.groupBy(*key).agg(F.count(F.lit(1)).alias("observations")))
    hot = sizes.where((F.col("observations") > hot_rows) & reduce(and_, [F.col(k).isNotNull() for k in key])).select(*key)
    plain = lambda rows: rows.groupBy(*key).agg(*[F.percentile(c, 0.5).alias(c) for c in cols], F.count(F.lit(1)).alias("observations"))
    if hot.isEmpty():
        return plain(df)
    large = df.join(hot, key, "left_semi")
    found = sizes.join(hot, key, "left_semi")
    for c in cols:
        found = found.join(quantile_columns(large, key, c, {c: 0.5}), key, "left")
    return plain(df.join(hot, key, "left_anti")).unionByName(found)


def clean_probabilities(df: DataFrame, key: list[str], p: str) -> DataFrame:
    ok = F.col(p).isNotNull() & ~F.isnan(p) & F.col(p).between(0.0, 1.0)
    return bucket_medians(df.where(ok), key, [p]).select(*key, F.col(p).alias("proba_up"))


def backtest_frame(probabilities: DataFrame, prices: DataFrame, key: list[str]) -> DataFrame:
    """Usable aligned rows; the outcome is strict: close above open."""
    def inside(c):
        return (F.col(c) > 0) & (F.col(c) < 1)

    ok = (F.col("proba_up").between(0.0, 1.0) & (F.col("open") > 0) & (F.col("close") > 0) & inside("ask_yes") & inside("ask_no"))
    tick = F.when(F.col("tick_size") > 0, F.col("tick_size")).otherwise(TICK_FALLBACK)
    return probabilities.join(prices, key).where(ok).withColumns(
        {"tick_size": tick, "actual_up": (F.col("close") > F.col("open")).cast("int")})


# ---- decisions -----------------------------------------------------------------------------------

def _missing(values: dict[str, Column], buffer) -> Column:
    notes = [F.when(v.isNull(), k) for k, v in {**values, "extra_buffer": buffer}.items()]
    p = values["proba_up"]
    notes.append(F.when((p < 0) | (p > 1), "proba_up_out_of_range"))
    notes += [F.when((values[k] <= 0) | (values[k] >= 1), f"{k}_out_of_range") for k in ("ask_yes", "ask_no")]
    notes += [F.when(values[k] < 0, f"{k}_negative") for k in ("fee_yes", "fee_no")]
    notes.append(F.when(buffer < 0, "extra_buffer_negative"))
    return F.array_join(F.array_compact(F.array(*notes)), ",")


def _snap(x: Column) -> Column:
    return F.when(F.abs(x) <= EPS, 0.0).otherwise(x)


def ev_decision(df: DataFrame, buffer=0.0) -> DataFrame:
    """Buy the side with the larger positive expected value; a tie goes to ``no``."""
    b = buffer if isinstance(buffer, Column) else F.lit(float(buffer))
    v = {k: F.col(k) for k in ("proba_up", "ask_yes", "ask_no", "fee_yes", "fee_no")}
    d = df.withColumn("_miss", _missing(v, b))
    ok = F.col("_miss") == ""
    yes = _snap(v["proba_up"] - v["ask_yes"] - v["fee_yes"] - b)
    no = _snap((1 - v["proba_up"]) - v["ask_no"] - v["fee_no"] - b)
    d = d.withColumns({"ev_yes": F.when(ok, yes), "ev_no": F.when(ok, no)})
    y, n = F.col("ev_yes"), F.col("ev_no")
    none = (y <= 0) & (n <= 0)
    return d.withColumns({
        "best_ev": F.greatest(y, n),
        "decision": F.when(~ok | none, "no_trade").when(y > n + EPS, "buy_yes").otherwise("buy_no"),
        "reason": F.when(~ok, F.concat(F.lit("missing_policy_input:"), "_miss")).when(none, "no_positive_ev").when(
            y > n + EPS, "yes_ev_gt_no_ev").otherwise("no_ev_gte_yes_ev")}).drop("_miss")


def threshold_decision(df: DataFrame, threshold: float, margin: float = 0.0, margin_up: float | None = None,
                       margin_down: float | None = None) -> DataFrame:
    """Follow the model side when it clears the threshold by the margin of that side."""
    p = F.col("proba_up")
    up = p >= threshold
    need = F.when(up, margin if margin_up is None else margin_up).otherwise(margin if margin_down is None else margin_down)
    have = F.when(up, p - threshold).otherwise(F.lit(threshold) - p)
    reason = (F.when(p.isNull(), "missing_policy_input:proba_up").when((p < 0) | (p > 1), "missing_policy_input:proba_up_out_of_range")
              .when(F.lit(not 0.0 <= threshold <= 1.0), "invalid_model_threshold").when(need < 0, "invalid_min_decision_margin")
              .when((need > 0) & (have < need), "below_min_decision_margin").otherwise("model_direction_threshold"))
    d = df.withColumn("reason", reason)
    return d.withColumn("decision", F.when(F.col("reason") != "model_direction_threshold", "no_trade").when(up, "buy_yes").otherwise("buy_no"))


def submitted_price(entry, cap, mode: str, tick, ticks: int) -> tuple[Column, Column]:
    """``(price, error)`` for modes ``entry_price``, ``entry_price_plus_ticks`` and ``order_price_cap``."""
    e, c, t = col(entry), col(cap), col(tick)
    bad_entry = F.coalesce((e <= 0) | (e >= 1), F.lit(True))
    if mode in ("", "entry_price"):
        error = F.when(bad_entry, "invalid_entry_price").otherwise("")
        return F.when(~bad_entry, e), error
    bad_cap = F.coalesce((c <= 0) | (c >= 1), F.lit(True))
    error = F.when(bad_entry, "invalid_entry_price").when(bad_cap, "invalid_order_price_cap").when(
        e > c + EPS, "entry_price_above_order_price_cap")
    if mode == "entry_price_plus_ticks":
        price = F.bround(F.least(e + t * ticks, c), 4)
        error = error.when(F.coalesce(t <= 0, F.lit(True)), "invalid_tick_size").when(
            F.lit(ticks < 0), "invalid_submitted_price_slippage_ticks").when((price <= 0) | (price >= 1), "invalid_submitted_price")
    elif mode == "order_price_cap":
        price = c
    else:
        price, error = F.lit(None).cast("double"), F.lit(f"unsupported_submitted_price_mode:{mode}")
        return price, error
    error = error.otherwise("")
    return F.when(error == "", price), error


def round_up(x, decimals: int) -> Column:
    f = float(10 ** decimals)
    return F.ceil(col(x) * f - 1e-12) / f


def minimum_stake(price, fee: Fee, min_shares, decimals: int = STAKE_DECIMALS, steps: int = ADJUST_STEPS) -> Column:
    """Smallest rounded stake that still buys the minimum shares after the fee.

    ``steps`` increments are tried; past them the next stake stands, which ``stake_met`` tells from a valid one.
    """
    p, m = col(price), col(min_shares)
    share = fee.fraction(p)
    first = round_up(m * p / F.greatest(1 - share, F.lit(EPS)), decimals)
    inc = float(10 ** -decimals)
    tries = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: round_up(first + k * inc, decimals))
    fits = F.filter(F.slice(tries, 1, steps), lambda s: (s - fee.from_notional(s, p)) / p + EPS >= m)
    value = F.coalesce(F.try_element_at(fits, F.lit(1)), F.element_at(tries, -1))
    return F.when((p <= 0) | (p >= 1), None).when(m <= 0, 0.0).when(share < 1, value)


def stake_met(stake, price, fee: Fee, min_shares) -> Column:
    """Whether a stake buys the minimum shares after the fee; NULL without a stake."""
    s, p = col(stake), col(price)
    return F.when(s.isNotNull(), (s - fee.from_notional(s, p)) / p + EPS >= col(min_shares))


def trade_intent(df: DataFrame, fee: Fee, *, bankroll, multiplier, min_shares, mode: str = "fixed", initial_bankroll=None,
                 balance=None, cap=None) -> DataFrame:
    """Side, price, stake, fee and shares of a decision, with the first rule that stops it as ``final_reason``."""
    bank, m = col(bankroll), col(multiplier)
    side = F.when(F.col("decision") == "buy_yes", "yes").when(F.col("decision") == "buy_no", "no").otherwise("none")
    if mode == "return_multiple":
        init, bal = col(initial_bankroll), F.when(col(balance) > 0, col(balance)).otherwise(bank)
        m = F.when(bal > init, bal / init).otherwise(1.0)
    else:
        init = F.lit(1.0)
    entry = F.when(side == "yes", F.col("ask_yes")).when(side == "no", F.col("ask_no"))
    d = df.withColumns({"trade_side": side, "entry_price": entry, "stake_multiplier": m})
    d = d.withColumn("required_stake", minimum_stake("entry_price", fee, min_shares))
    stake = F.col("required_stake") * F.col("stake_multiplier")
    d = d.withColumn("stake", round_up(stake, STAKE_DECIMALS) if mode == "return_multiple" else stake)
    d = d.withColumn("fee", fee.from_notional("stake", "entry_price"))
    d = d.withColumn("shares_net", (F.col("stake") - F.col("fee")) / F.col("entry_price"))
    over_cap = F.lit(False) if cap is None else F.coalesce(F.col("stake") > col(cap), F.lit(False))
    reason = (F.when(F.col("decision") == "no_trade", F.col("reason"))
              .when(F.coalesce(bank <= 0, F.lit(True)), "bankroll_non_positive")
              .when(F.lit(mode not in ("fixed", "return_multiple")), "unsupported_stake_multiplier_mode")
              .when(F.coalesce(init <= 0, F.lit(True)), "initial_bankroll_non_positive")
              .when(F.coalesce(F.col("stake_multiplier") <= 0, F.lit(True)), "stake_multiplier_non_positive")
              .when(F.coalesce(F.col("required_stake") <= 0, F.lit(True)), "required_stake_unavailable")
              .when(F.col("stake") > bank, "stake_above_bankroll").when(over_cap, "stake_above_external_cap")
              .when(F.col("fee") >= F.col("stake"), "fee_ge_stake").when(F.col("shares_net") < col(min_shares), "shares_below_order_min")
              .otherwise("ok"))
    d = d.withColumn("final_reason", reason)
    ok = F.col("final_reason") == "ok"
    return d.withColumns({"decision": F.when(ok, F.col("decision")).otherwise("no_trade"),
                          "trade_side": F.when(ok, F.col("trade_side")).otherwise("none"),
                          "bet": F.when(ok, F.col("stake")).otherwise(0.0)})


def recommendation(df: DataFrame, fee: Fee, *, policy: str, threshold: float, buffer: float, bankroll, multiplier, min_shares,
                   min_seconds: float, cap, price_cap: float, price_mode: str, ticks: int) -> DataFrame:
    """Full gate: market state, decision policy, stake, exposure cap, submitted price."""
    d = df.withColumns({"fee_yes": fee.fraction("ask_yes"), "fee_no": fee.fraction("ask_no")})
    d = ev_decision(d, buffer) if policy == "ev" else threshold_decision(d, threshold)
    d = trade_intent(d, fee, bankroll=bankroll, multiplier=multiplier, min_shares=min_shares, cap=cap)
    gate = F.when(~F.col("accepting"), "market_not_accepting").when(F.col("seconds_to_close") < min_seconds, "too_close_to_end").when(
        col(bankroll) <= 0, "bankroll_non_positive")
    price, error = submitted_price("entry_price", F.lit(price_cap), price_mode, "tick_size", ticks)
    d = d.withColumns({"submit_price": price, "_err": error})
    final = gate.when(F.col("final_reason") != "ok", F.col("final_reason")).when(F.col("_err") != "", F.col("_err")).otherwise("ok")
    return d.withColumn("gate_reason", final).withColumn("bet", F.when(F.col("gate_reason") == "ok", F.col("bet")).otherwise(0.0)).drop("_err")


# ---- replay ----------------------------------------------------------------------------------------

def replay_trades(frame: DataFrame, fee: Fee, buffer, *, price_cap: float, price_mode: str = "entry_price", ticks: int = 0) -> DataFrame:
    """Every row with its decision, skip reason, and profit of one unit of shares at the submitted price."""
    d = frame.withColumns({"fee_yes": fee.fraction("ask_yes"), "fee_no": fee.fraction("ask_no")})
    d = ev_decision(d, buffer)
    yes = F.col("decision") == "buy_yes"
    d = d.withColumn("entry_price", F.when(yes, F.col("ask_yes")).when(F.col("decision") == "buy_no", F.col("ask_no")))
    price, error = submitted_price("entry_price", F.lit(price_cap), price_mode, "tick_size", ticks)
    traded = F.col("decision") != "no_trade"
    d = d.withColumns({"price": F.when(traded, price), "skip": F.when(~traded, "no_trade").when(error != "", "submission").otherwise("")})
    win = F.when(yes, F.col("actual_up") == 1).otherwise(F.col("actual_up") == 0)
    shares = (F.col("price") - fee.from_notional("price", "price")) / F.col("price")
    d = d.withColumn("is_win", F.when(F.col("skip") == "", win))
    pnl = F.when(F.col("is_win"), shares).otherwise(0.0) - F.col("price")
    d = d.withColumn("pnl", F.when(F.col("skip") == "", pnl))
    return d.withColumn("ret", F.col("pnl") / F.col("price"))


def replay_summary(trades: DataFrame, layout: Layout) -> DataFrame:
    """Profit, risk and objective per key of ``layout``; the drawdown runs over two-level scans."""
    d = settle(running(settle(trades), layout, _cum=("sum", F.coalesce("pnl", F.lit(0.0)))))
    d = running(d, layout, _peak=("max", F.greatest(F.col("_cum"), F.lit(0.0))))
    done = F.col("skip") == ""
    down = F.sqrt(F.avg(F.when(done, F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2)))))
    out = d.groupBy(*layout.key).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(done).alias("executed"), F.avg(F.when(done, F.col("is_win").cast("double"))).alias("win_rate"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_profit"), F.sum(F.when(done, F.col("price"))).alias("total_stake"), F.avg("pnl").alias("mean_pnl"),
        F.stddev_samp("pnl").alias("std_pnl"), F.avg("ret").alias("mean_return"), F.stddev_samp("ret").alias("std_return"),
        down.alias("downside"), F.max(F.when(done, F.col("_peak") - F.col("_cum"))).alias("max_drawdown"),
        F.count_if(done & (F.col("decision") == "buy_yes")).alias("yes_trades"), F.count_if(done & (F.col("decision") == "buy_no")).alias("no_trades"),
        F.count_if(F.col("skip") == "no_trade").alias("skipped_no_trade"), F.count_if(F.col("skip") == "submission").alias("skipped_submission"))
    score = F.when(F.col("executed") == 0, NO_TRADE_OBJECTIVE).otherwise(F.col("total_profit") / F.greatest("downside", F.lit(DOWNSIDE_EPS)))
    return out.withColumns({"objective": score, "trade_rate": F.col("executed") / F.col("row_count")})


def scan_buffers(frame: DataFrame, fee: Fee, buffers: list[float], layout: Layout, **kw) -> DataFrame:
    """Replay every candidate buffer in one job: rows fan out by candidate, the candidate joins the key."""
    wide = frame.withColumn("buffer", F.explode(F.array(*[F.lit(float(b)) for b in buffers])))
    return replay_summary(replay_trades(wide, fee, F.col("buffer"), **kw), layout.keyed(*layout.key, "buffer"))


def best_candidate(scan: DataFrame, key: list[str], objective: str = "objective") -> DataFrame:
    """The candidate of the highest objective; of those equal to ``TIE_DIGITS`` digits the one with the smallest buffer."""
    names = [c for c in scan.columns if c not in key]
    rank = F.struct(F.round(objective, TIE_DIGITS), -F.col("buffer"))
    return scan.groupBy(*key).agg(F.max_by(F.struct(*names), rank).alias("r")).select(*key, "r.*")
