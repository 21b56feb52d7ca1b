"""Prediction records: ids, outcomes, settlement, statistics, reconciliation, positions and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import col, finite, quotient
from barloom.operators.ordered import Layout, running
from barloom.operators.policy import Fee

OPEN_STATES = ("exit_submitted", "redeem_submitted", "redeem_confirmed_waiting_close_sync", "closed")


def text(c) -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def stable_id(record_id, bucket, asset, prediction) -> Column:
    """Own id, else ``bucket:``, ``external:``, ``prediction:`` by what is present, else empty."""
    def iso(c):
        return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(F.nullif(text(record_id), F.lit("")), F.concat(F.lit("bucket:"), iso(bucket)),
                      F.concat(F.lit("external:"), F.nullif(text(asset), F.lit(""))), F.concat(F.lit("prediction:"), iso(prediction)), F.lit(""))


def backfill_prices(records: DataFrame, candles: DataFrame, key: list[str]) -> DataFrame:
    """Bucket open and close from candles at bucket start and end where the record has none."""
    o = candles.select(*key, F.col("ts").alias("bucket_start"), F.col("open").alias("_o"))
    c = candles.select(*key, F.col("ts").alias("bucket_last"), F.col("close").alias("_c"))
    d = records.join(o, [*key, "bucket_start"], "left").join(c, [*key, "bucket_last"], "left")
    return d.withColumns({"bucket_open": F.coalesce("bucket_open", "_o"), "bucket_close": F.coalesce("bucket_close", "_c")}).drop("_o", "_c")


_MARKET = ("umaResolutionStatus string, winning_outcome string, outcomes array<string>, outcomePrices array<string>, "
           "clobTokenIds array<string>, tickSize double")


def _side(label: Column) -> Column:
    s = F.lower(F.trim(label))
    return F.when(s.isin("up", "yes"), 1).when(s.isin("down", "no"), 0)


def market_outcome(df: DataFrame, payload: str, out: str = "actual_up") -> DataFrame:
    """Named winner, else the outcome priced at one, else the unique maximum once resolved."""
    d = df.withColumn("_m", F.from_json(F.col(payload), _MARKET))
    m = F.col("_m")
    prices = F.transform(m["outcomePrices"], lambda x: x.try_cast("double"))
    valid = (F.size(m["outcomes"]) == 2) & (F.size(prices) == 2) & ~F.exists(prices, lambda x: x.isNull())
    at_one = F.array_position(F.transform(prices, lambda x: (F.abs(x - 1.0) <= 1e-9).cast("int")), 1)
    top = F.array_max(prices)
    unique = F.size(F.filter(prices, lambda x: x == top)) == 1
    idx = F.when(at_one > 0, at_one).when((F.lower(F.trim(m["umaResolutionStatus"])) == "resolved") & unique, F.array_position(prices, top))
    label = F.when(valid, F.try_element_at(m["outcomes"], idx.cast("int")))
    return d.withColumn(out, F.coalesce(_side(m["winning_outcome"]), _side(label))).drop("_m")


def side_correct(side, actual) -> Column:
    s, a = F.lower(text(side)), col(actual)
    return F.when(s == "yes", (a == 1).cast("int")).when(s == "no", (a == 0).cast("int"))


def model_side(p, threshold: float = 0.5) -> Column:
    v = finite(col(p).try_cast("double"))
    return F.when(v.isNull(), "none").when(v >= threshold, "up").otherwise("down")


def model_correct(p, actual, threshold: float = 0.5) -> Column:
    s, a = model_side(p, threshold), col(actual)
    return F.when(s == "up", (a == 1).cast("int")).when(s == "down", (a == 0).cast("int"))


def running_win_rates(records: DataFrame, resolved: str, traded: str, layout: Layout) -> DataFrame:
    r, t = F.col(resolved), F.col(resolved) & F.col(traded)
    d = running(records, layout, _n=("count", F.when(r, 1)), _w=("sum", F.when(r, F.coalesce("is_correct", F.lit(0))).otherwise(0)),
                _tn=("count", F.when(t, 1)), _tw=("sum", F.when(t, F.coalesce("trade_is_win", F.lit(0))).otherwise(0)))
    return d.withColumns({"policy_rate": F.when(r, F.col("_w") / F.col("_n")),
                          "trade_rate": F.when(r & (F.col("_tn") > 0), F.col("_tw") / F.nullif("_tn", F.lit(0)))}).drop("_n", "_w", "_tn", "_tw")


def record_statistics(records: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Counts, rates and profit by status class in one aggregate."""
    s = F.col(status)
    resolved, traded = F.col("actual_up").isNotNull(), F.col("trade_side").isin("yes", "no")
    closed = s == "closed"
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(resolved).alias("resolved"), F.count_if(traded).alias("trades"),
        F.count_if(closed).alias("closed"), F.count_if(traded & ~closed).alias("open"),
        F.avg(F.when(resolved, F.col("is_correct"))).alias("policy_win_rate"), F.avg(F.when(closed, F.col("trade_is_win"))).alias("trade_win_rate"),
        F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("closed_pnl"),
        F.coalesce(F.sum(F.when(traded & ~closed, F.col("pnl"))), F.lit(0.0)).alias("pending_pnl"),
        F.coalesce(F.sum(F.when(traded, F.col("stake"))), F.lit(0.0)).alias("staked"))


def _positive(*cols) -> Column:
    return F.coalesce(*[F.when(finite(col(c).cast("double")) > 0, col(c).cast("double")) for c in cols])


def settle_records(df: DataFrame, prefer_api: bool = False, shares=("closed_shares", "shares_net", "shares_orig"),
                   stakes=("filled_stake", "stake_orig", "submitted_stake", "stake")) -> DataFrame:
    """Profit and payout by precedence: API profit, outcome and shares, fallback to API profit."""
    have = set(df.columns)
    sh = _positive(*[c for c in shares if c in have])
    api = F.col("realized_pnl") if "realized_pnl" in have else F.lit(None).cast("double")
    avg = F.col("avg_price") if "avg_price" in have else F.lit(None).cast("double")
    st = F.coalesce(_positive(*[c for c in stakes if c in have]), F.when(avg > 0, sh * avg))
    d = df.withColumns({"_sh": sh, "_st": st, "_won": side_correct("trade_side", "actual_up")})
    by_outcome = F.col("_won").isNotNull() & F.col("_st").isNotNull()
    use_api = api.isNotNull() & (F.lit(prefer_api) | ~by_outcome)
    payout = F.when(F.col("_won") == 1, F.coalesce("_sh", F.lit(0.0))).otherwise(0.0)
    api_pay = F.col("_st") + api
    return d.withColumns({
        "pnl": F.when(use_api, api).when(by_outcome, payout - F.col("_st")),
        "payout": F.when(use_api, F.when(F.abs(api_pay) <= 1e-6, 0.0).otherwise(api_pay)).when(by_outcome, payout),
        "payout_source": F.when(~use_api & by_outcome, "settlement_outcome_shares").otherwise("data_api_closed_positions"),
        "settled_stake": F.col("_st"), "settled_shares": F.col("_sh")}).withColumn(
        "trade_is_win", F.when(F.col("pnl").isNotNull(), (F.col("pnl") > 0).cast("int"))).drop("_sh", "_st", "_won")


def fill_fields(df: DataFrame, response: str) -> DataFrame:
    """Filled shares, stake and average price of an order response, falling back to what was requested.

    A response without shares has no price; a stake requested for no shares has an infinite one.
    """
    def num(path):
        return F.get_json_object(F.col(response), path).try_cast("double")
    shares = F.coalesce(num("$.takingAmount"), num("$.filled.shares"), F.col("requested_shares"))
    stake = F.coalesce(num("$.makingAmount"), num("$.filled.stake"), F.col("requested_stake"))
    answered = num("$.takingAmount").isNotNull() | num("$.filled.shares").isNotNull()
    return df.withColumns({"filled_shares": shares, "filled_stake": stake, "fill_price": F.when(~answered | (shares > 0), quotient(stake, shares)),
                           "fill_source": F.when(answered, "response").otherwise("requested")})


def local_outcome_pnl(records: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Pending records settled from local outcomes; settled ones stay as they are."""
    d = records.join(outcomes.select(*key, F.col("actual_up").alias("_up")), key, "left")
    d = d.withColumn("actual_up", F.coalesce("actual_up", "_up")).drop("_up")
    pend = d.withColumnsRenamed({"pnl": "_old_pnl"})
    s = settle_records(pend)
    return s.withColumn("pnl", F.coalesce("_old_pnl", "pnl")).drop("_old_pnl")


def latest_positions(positions: DataFrame, key: str = "asset") -> DataFrame:
    """Latest closed position per asset; a later row wins a tie of times."""
    names = [c for c in positions.columns if c != key]
    return positions.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("closed_at", "row_id")).alias("_r")).select(key, "_r.*")


def reconcile(records: DataFrame, closed: DataFrame, opened: DataFrame, key: str = "asset") -> DataFrame:
    """Records with the newest closed position settled in, and entry fields filled once from open positions."""
    c = latest_positions(closed).select(key, F.col("shares").alias("closed_shares"), F.col("realized_pnl"), F.col("avg_price"), F.lit(True).alias("_closed"))
    o = opened.groupBy(key).agg(F.max("size").alias("_size"), F.max("avg_price").alias("_entry"))
    d = records.join(c, key, "left").join(o, key, "left")
    d = d.withColumns({"entry_shares": F.coalesce("entry_shares", "_size"), "entry_price": F.coalesce("entry_price", "_entry")})
    s = settle_records(d)
    state = F.when(F.col("_closed"), "closed").when(F.col("_size").isNotNull(), "open").otherwise(F.col("status"))
    done = F.coalesce(F.col("_closed"), F.lit(False))
    return s.withColumns({"status": state, "pnl": F.when(done, F.col("pnl")), "trade_is_win": F.when(done, F.col("trade_is_win"))}).drop("_closed", "_size", "_entry")


def slug_matches(slug, prefix: str) -> Column:
    s = text(slug)
    return F.when((s == "") | F.lit(prefix.strip() == ""), False).otherwise((s == prefix.strip()) | s.startswith(prefix.strip() + "-"))


def redeem_candidates(positions: DataFrame, records: DataFrame, prefix: str, require_redeemable: bool = True) -> DataFrame:
    """Reason code per managed position, in position order; the first eligible position of a condition wins."""
    won = F.col("won")
    live = records.where((text("mode") == "live") & (text("condition_id") != ""))
    cond = live.groupBy("condition_id").agg(F.max(F.col("resolved").cast("int")).alias("_resolved"), F.max(won.cast("int")).alias("_won"))
    match = live.where(won).groupBy("condition_id", "asset").agg(
        F.lit(1).alias("_match"), F.max(F.when(F.col("status").isin("redeem_submitted", "redeem_confirmed"), F.concat(F.lit("already_"), "status"))).alias("_idem"))
    p = positions.where(slug_matches("slug", prefix)).withColumn("condition_id", text("condition_id"))
    d = p.join(cond, "condition_id", "left").join(match, ["condition_id", "asset"], "left")
    base = (F.when(F.col("condition_id") == "", "missing_condition_id").when(~F.col("condition_id").rlike("^0x[0-9a-fA-F]{64}$"), "invalid_condition_id")
            .when(F.col("negative_risk"), "negative_risk_unsupported").when(F.col("_resolved").isNull(), "untracked_condition")
            .when(F.col("_resolved") == 0, "unresolved_local_state").when(F.col("_won") == 0, "local_outcome_not_winning")
            .when(F.col("_match").isNull(), "position_asset_not_winning_record").when(F.col("_idem").isNotNull(), F.col("_idem"))
            .when(F.lit(require_redeemable) & ~F.col("redeemable"), "not_redeemable").otherwise("eligible"))
    d = d.withColumn("reason", base)
    blocks = F.col("reason").isin("negative_risk_unsupported", "local_outcome_not_winning") | F.col("reason").startswith("already_")
    ends = d.where(blocks | (F.col("reason") == "eligible")).groupBy("condition_id").agg(
        F.min(F.struct("position_id", F.when(blocks, "blocked").otherwise("accepted").alias("how"))).alias("_end"))
    d = d.join(ends, "condition_id", "left")
    after = F.coalesce(F.col("position_id") > F.col("_end.position_id"), F.lit(False)) & ~F.col("reason").isin("missing_condition_id", "invalid_condition_id")
    reason = F.when(after & (F.col("_end.how") == "accepted"), "duplicate_condition_id").when(after, "condition_already_blocked").otherwise(F.col("reason"))
    return d.select("position_id", "condition_id", "asset", reason.alias("reason")).withColumn(
        "action", F.when(F.col("reason") == "eligible", "candidate").otherwise("skip"))


def exit_candidates(positions: DataFrame, records: DataFrame, books: DataFrame, fee: Fee, *, tolerance: float, min_seconds: float,
                    min_profit: float, min_roi: float) -> DataFrame:
    """Open positions worth selling now: enough profit, and not much less than redeeming would bring."""
    r = records.where((text("mode") == "live") & F.col("actual_up").isNull() & ~F.coalesce(F.col("status").isin(*OPEN_STATES), F.lit(False)))
    d = positions.join(r.select("asset", "stake", "seconds_to_close"), "asset").join(books.select("asset", "best_bid"), "asset")
    d = d.where((F.col("size") > 0) & (F.col("best_bid") > 0) & (F.col("stake") > 0))
    net = F.col("size") * F.col("best_bid") - fee.from_shares("size", "best_bid")
    d = d.withColumns({"pnl": net - F.col("stake"), "redeem_pnl": F.col("size") - F.col("stake")})
    d = d.withColumn("roi", F.col("pnl") / F.col("stake"))
    keeps = (F.col("redeem_pnl") <= 0) | (F.col("pnl") >= F.col("redeem_pnl") * (1 - tolerance))
    return d.where(keeps & (F.col("seconds_to_close") > min_seconds) & (F.col("pnl") >= min_profit) & (F.col("roi") >= min_roi))


def best_level(levels, side: str) -> tuple[Column, Column]:
    """Best price and total size resting at it; ``levels`` is ``array<struct<price,size>>``."""
    lv = F.filter(col(levels), lambda x: finite(x["price"]).isNotNull())
    prices = F.transform(lv, lambda x: x["price"])
    best = F.array_min(prices) if side == "ask" else F.array_max(prices)
    at = F.filter(lv, lambda x: (F.abs(x["price"] - best) <= 1e-12) & finite(x["size"]).isNotNull())
    size = F.when(F.size(at) > 0, F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x["size"]))
    return best, size


def market_snapshot(df: DataFrame, payload: str, books: DataFrame, fallback_tick: float = 0.01) -> DataFrame:
    """One row per market token: outcome label, best quotes with sizes, tick size."""
    m = F.from_json(F.col(payload), _MARKET)
    rest = [c for c in df.columns if c != payload]
    d = df.withColumn("_m", m)
    rows = d.select(*rest, F.coalesce("_m.tickSize", F.lit(fallback_tick)).alias("tick_size"),
                    F.inline(F.arrays_zip(F.col("_m.clobTokenIds").alias("token"), F.col("_m.outcomes").alias("outcome"))))
    b = books.select(F.col("asset").alias("token"), *[c.alias(n) for s, f in (("bids", "bid"), ("asks", "ask"))
                                                      for n, c in zip((f"best_{f}", f"{f}_size"), best_level(s, f))])
    return rows.join(b, "token", "left")


def external_records(positions: DataFrame, records: DataFrame) -> DataFrame:
    """New records for positions nothing local knows about."""
    d = positions.join(records.select("asset").distinct(), "asset", "left_anti")
    return d.withColumns({"record_id": F.concat(F.lit("external:"), "asset"), "status": F.lit("open"), "origin": F.lit("external")})
