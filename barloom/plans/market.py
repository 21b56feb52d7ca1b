"""Queries: bars, resampling, alignment, candle features."""

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.operators import candles, resample, targets
from barloom.operators.ordered import asof, settle
from barloom.plans.base import CTES, HOUR, HOURLY, query

BAR = "symbol:s ts:t open:d high:d low:d close:d volume:d"

CTES["targeted"] = """SELECT a.*, CASE WHEN b.close IS NULL THEN NULL WHEN b.close >= a.close THEN 1 ELSE 0 END AS target
    FROM hourly a LEFT JOIN hourly b ON a.symbol = b.symbol AND b.ts = a.ts + INTERVAL 5 HOUR"""
CTES["shaped"] = """SELECT *, (close-open)/nullif(open,0) AS candle_ret_co, (high-low)/nullif(open,0) AS candle_range_ho,
    abs(close-open)/nullif(open,0) AS candle_body_abs_open, (close-open)/(high-low+1e-12) AS candle_body_pressure,
    sign(close-open) AS candle_signed_vol, CASE WHEN volume = 0 THEN 0 ELSE sign(close-open) END AS candle_up_down_vol_log_ratio,
    ((high-greatest(open,close)) - (least(open,close)-low))/(high-low+1e-12) AS candle_wick_asym,
    (close-low)/(high-low+1e-12) AS candle_close_location_value FROM hourly"""


@query("flagship_features_target", "RSP01 RSP04 RSP05 FEA01 FEA04 TGT01 TGT04 TGT08",
       BAR + " candle_ret_co 4h_candle_ret_co_lag1:d 4h_candle_ret_co_lag2:d target:i target_weight:d is_decision:i"
       .replace("4h_", "h4_"),
       """SELECT t.*, e.lag1 AS h4_candle_ret_co_lag1, e.lag2 AS h4_candle_ret_co_lag2,
            (t.close-t.open)/nullif(t.open,0) AS candle_ret_co,
            CASE WHEN hour(t.ts) % 5 = 4 THEN 0.4625 ELSE 0.134375 END AS target_weight,
            CASE WHEN hour(t.ts) % 5 = 4 THEN 1 ELSE 0 END AS is_decision
          FROM targeted t ASOF LEFT JOIN (
            SELECT symbol, close_ts, (close-open)/nullif(open,0) AS lag1,
              lag((close-open)/nullif(open,0)) OVER (PARTITION BY symbol ORDER BY bts) AS lag2 FROM coarse4h) e
          ON t.symbol = e.symbol AND t.ts >= e.close_ts""")
def flagship(t):
    bars = t.hourly
    wide = candles.coarse_shape_lags(candles.shape_features(bars), "4h", HOUR, ["candle_ret_co"], 2, HOURLY)
    out = targets.exact_target(wide, 5 * HOUR, "target")
    out = out.withColumns({"h4_candle_ret_co_lag1": F.col("4h_candle_ret_co_lag1"),
                           "h4_candle_ret_co_lag2": F.col("4h_candle_ret_co_lag2"),
                           "is_decision": F.hour("ts") % 5 == 4})
    return targets.decision_weights(out, F.col("is_decision"), "target_weight")


@query("tick_bars_covered", "RSP01 STR11", BAR,
       """SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, n AS volume FROM (
            SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high,
              min(price) AS low, last(price ORDER BY ts, event_id) AS close, count(*) AS n FROM ticks GROUP BY 1, 2) b
          JOIN (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM ticks GROUP BY 1) c ON b.symbol = c.symbol
          WHERE b.ts >= lo AND b.ts + INTERVAL 1 HOUR <= hi""")
def tick_bars_covered(t):
    return resample.tick_bars(t.ticks, HOUR, volume="count", covered=True)


@query("coarser_by_coverage", "RSP02", BAR,
       """SELECT b.* FROM (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, first(open ORDER BY ts) AS open,
            max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
            FROM hourly GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts)) b
          JOIN (SELECT symbol, min(ts) AS lo, max(ts) + INTERVAL 1 HOUR AS hi FROM hourly GROUP BY 1) c
          ON b.symbol = c.symbol WHERE b.ts >= lo AND b.ts + INTERVAL 4 HOUR <= hi""")
def coarser_by_coverage(t):
    return resample.coarser_bars(t.hourly, 4 * HOUR, HOUR)


@query("exact_count_bars", "RSP03", BAR, "SELECT symbol, bts AS ts, open, high, low, close, volume FROM coarse4h")
def exact_count_bars(t):
    return resample.exact_count_bars(t.hourly, 4 * HOUR, 4)


_LABELS = ["1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1month"]


def _complete_sql():
    parts = []
    for label in _LABELS:
        if label == "1month":
            b, width = "date_trunc('month', ts)", "date_diff('hour', bts, bts + INTERVAL 1 MONTH)"
            end = "bts + INTERVAL 1 MONTH"
        else:
            hours = resample.INTERVALS[label] // HOUR
            origin = {"1w": "TIMESTAMP '1970-01-05'", "3d": "CAST(o AS TIMESTAMP)"}.get(label, "TIMESTAMP '1970-01-01'")
            b, width, end = f"time_bucket(INTERVAL {hours} HOUR, ts, {origin})", str(hours), f"bts + INTERVAL {hours} HOUR"
        parts.append(f"""SELECT '{label}' AS interval_label, symbol, bts AS ts, open, high, low, close, volume,
            {end} - INTERVAL 1 HOUR AS close_ts FROM (
              SELECT symbol, {b} AS bts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
                last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n
              FROM (SELECT *, date_trunc('day', min(ts) OVER (PARTITION BY symbol)) AS o FROM hourly)
              GROUP BY symbol, bts) WHERE n = {width}""")
    return "\nUNION ALL\n".join(parts)


@query("complete_intervals", "RSP04 RSP08", "interval_label:s " + BAR + " close_ts:t", _complete_sql())
def complete_intervals(t):
    out, bars = None, settle(t.hourly)  # bars are built once for all intervals
    for label in resample.interval_rules(_LABELS):
        part = resample.complete_bars(bars, label, HOUR).withColumn("interval_label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


@query("asof_backward", "RSP05", "symbol:s ts:t close:d h4_close:d",
       """SELECT h.symbol, h.ts, h.close, e.close AS h4_close FROM hourly h
          ASOF LEFT JOIN coarse4h e ON h.symbol = e.symbol AND h.ts >= e.close_ts""")
def asof_backward(t):
    ev = resample.complete_bars(t.hourly, "4h", HOUR).select("symbol", F.col("close_ts").alias("ts"),
                                                           F.col("close").alias("h4_close"))
    return asof(t.hourly.select("symbol", "ts", "close"), ev, HOURLY)


@query("ticks_asof_quotes", "RSP05", "symbol:s event_id:i price:d bar_close:d",
       """SELECT k.symbol, k.event_id, k.price, e.close AS bar_close FROM ticks k
          ASOF LEFT JOIN coarse4h e ON k.symbol = e.symbol AND k.ts >= e.close_ts""")
def ticks_asof_quotes(t):
    ev = resample.complete_bars(t.hourly, "4h", HOUR).select("symbol", F.col("close_ts").alias("ts"),
                                                           F.col("close").alias("bar_close"))
    return asof(t.ticks.select("symbol", "ts", "event_id", "price"), ev, replace(HOURLY, rows=4_096, by_rows=True))


@query("latest_complete_bar", "RSP06", BAR + " close_ts:t",
       """SELECT symbol, bts AS ts, open, high, low, close, volume, close_ts FROM coarse4h
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bts DESC) = 1""")
def latest_complete_bar(t):
    return resample.latest_complete(t.hourly, "4h", HOUR)


@query("decision_clock", "RSP07 STR09", "symbol:s ts:t bucket:t is_decision:i next_bucket:t",
       """SELECT symbol, ts, time_bucket(INTERVAL 4 HOUR, ts) AS bucket, hour(ts) % 4 = 3 AS is_decision,
          time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR AS next_bucket FROM hourly""")
def decision_clock(t):
    return resample.decision_clock(t.hourly, 4 * HOUR, HOUR)


@query("candle_shape", "FEA01", "symbol:s ts:t " + " ".join(candles.SHAPE_COLS),
       "SELECT * FROM shaped")
def candle_shape(t):
    return candles.shape_features(t.hourly)


@query("volume_split_bars", "FEA02", "symbol:s ts:t up_volume:d down_volume:d side:d",
       """SELECT symbol, bts AS ts, up_volume, down_volume, sign(up_volume-down_volume) AS side FROM coarse4h""")
def volume_split_bars(t):
    return (candles.shape_features(candles.split_volume_bars(t.hourly, "4h", HOUR))
            .withColumn("side", F.col("candle_up_down_vol_log_ratio")))


@query("candle_lags", "FEA03", "symbol:s ts:t candle_ret_co_1m_lag1 candle_ret_co_1m_lag2 candle_wick_asym_1m_lag1 candle_wick_asym_1m_lag2",
       """SELECT symbol, ts, lag(candle_ret_co) OVER w AS candle_ret_co_1m_lag1, lag(candle_ret_co, 2) OVER w AS candle_ret_co_1m_lag2,
          lag(candle_wick_asym) OVER w AS candle_wick_asym_1m_lag1, lag(candle_wick_asym, 2) OVER w AS candle_wick_asym_1m_lag2
          FROM shaped WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def candle_lags(t):
    return candles.shape_lags(t.hourly, ["candle_ret_co", "candle_wick_asym"], 2, HOURLY)


@query("coarse_candle_lags", "FEA04", "symbol:s ts:t a1:d a2:d a3:d",
       """SELECT h.symbol, h.ts, a1, a2, a3 FROM hourly h ASOF LEFT JOIN (
            SELECT symbol, close_ts, x AS a1, lag(x) OVER w AS a2, lag(x, 2) OVER w AS a3 FROM (
              SELECT symbol, bts, close_ts, (close-low)/(high-low+1e-12) AS x FROM coarse4h)
            WINDOW w AS (PARTITION BY symbol ORDER BY bts)) e ON h.symbol = e.symbol AND h.ts >= e.close_ts""")
def coarse_candle_lags(t):
    d = candles.coarse_shape_lags(t.hourly, "4h", HOUR, ["candle_close_location_value"], 3, HOURLY)
    return d.withColumns({f"a{k}": F.col(f"4h_candle_close_location_value_lag{k}") for k in (1, 2, 3)})


def _pattern_sql():
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c[:2]}{k}" for k in (1, 2) for c in ("op", "hi", "lo", "cl", "ab", "ar"))
    body = {k: f"abs(cl{k}-op{k})" for k in (0, 1, 2)}
    top = {k: f"greatest(op{k},cl{k})" for k in (0, 1, 2)}
    bot = {k: f"least(op{k},cl{k})" for k in (0, 1, 2)}
    up = {k: f"(cl{k}>=op{k})" for k in (0, 1, 2)}
    dn = {k: f"(cl{k}<op{k})" for k in (0, 1, 2)}
    long = {k: f"({body[k]}>ab{k})" for k in (0, 1, 2)}
    short = {k: f"({body[k]}<ab{k})" for k in (0, 1, 2)}
    us = {k: f"(hi{k}-{top[k]})" for k in (0, 1, 2)}
    ls = {k: f"({bot[k]}-lo{k})" for k in (0, 1, 2)}
    nu = {k: f"({us[k]}<ar{k}*0.1)" for k in (0, 1, 2)}
    nl = {k: f"({ls[k]}<ar{k}*0.1)" for k in (0, 1, 2)}
    doji = f"({body[0]}<=ar0*0.1)"
    rules = {
        "doji": (doji, None), "dragonfly_doji": (f"{doji} AND {nu[0]} AND NOT {nl[0]}", None),
        "gravestone_doji": (f"{doji} AND {nl[0]} AND NOT {nu[0]}", None),
        "marubozu": (f"{long[0]} AND {nu[0]} AND {nl[0]} AND {up[0]}", f"{long[0]} AND {nu[0]} AND {nl[0]} AND {dn[0]}"),
        "spinning_top": (f"{short[0]} AND {us[0]}>{body[0]} AND {ls[0]}>{body[0]} AND {up[0]}",
                         f"{short[0]} AND {us[0]}>{body[0]} AND {ls[0]}>{body[0]} AND {dn[0]}"),
        "hammer": (f"{short[0]} AND {ls[0]}>{body[0]} AND {nu[0]} AND {bot[0]}<=lo1+ar1*0.2", None),
        "shooting_star": (None, f"{short[0]} AND {us[0]}>{body[0]} AND {nl[0]} AND {bot[0]}>{top[1]}"),
        "engulfing": (f"{up[0]} AND {dn[1]} AND cl0>op1 AND op0<cl1", f"{dn[0]} AND {up[1]} AND op0>cl1 AND cl0<op1"),
        "harami": (f"{long[1]} AND {short[0]} AND {top[0]}<{top[1]} AND {bot[0]}>{bot[1]} AND {dn[1]}",
                   f"{long[1]} AND {short[0]} AND {top[0]}<{top[1]} AND {bot[0]}>{bot[1]} AND {up[1]}"),
        "piercing": (f"{dn[1]} AND {long[1]} AND {up[0]} AND {long[0]} AND op0<lo1 AND cl0<op1 AND cl0>cl1+{body[1]}*0.5", None),
        "dark_cloud_cover": (None, f"{up[1]} AND {long[1]} AND {dn[0]} AND op0>hi1 AND cl0>op1 AND cl0<cl1-{body[1]}*0.5"),
        "morning_star": (f"{long[2]} AND {dn[2]} AND {short[1]} AND {top[1]}<{bot[2]} AND {up[0]} AND cl0>cl2+{body[2]}*0.3", None),
        "evening_star": (None, f"{long[2]} AND {up[2]} AND {short[1]} AND {bot[1]}>{top[2]} AND {dn[0]} AND cl0<cl2-{body[2]}*0.3"),
        "three_white_soldiers": (" AND ".join([up[2], up[1], up[0], "cl0>cl1", "cl1>cl2", "op1>op2", "op1<=cl2", "op0>op1",
                                              "op0<=cl1", nu[0], nu[1], nu[2]]), None),
        "three_black_crows": (None, " AND ".join([dn[2], dn[1], dn[0], "cl0<cl1", "cl1<cl2", "op1<op2", "op1>cl2", "op0<op1",
                                                  "op0>cl1", nl[0], nl[1], nl[2]])),
    }
    outs = []
    for n in candles.PATTERNS:
        bull, bear = rules[n]
        outs.append("CASE WHEN i < 12 THEN 0" + (f" WHEN {bull} THEN 100" if bull else "") +
                    (f" WHEN {bear} THEN -100" if bear else "") + f" ELSE 0 END AS cdl_{n}")
    return f"""SELECT symbol, ts, {', '.join(outs)} FROM (SELECT *, {lags} FROM (
        SELECT symbol, ts, open AS op, high AS hi, low AS lo, close AS cl, open AS op0, high AS hi0, low AS lo0, close AS cl0,
          avg(abs(close-open)) OVER p AS ab, avg(high-low) OVER p AS ar, avg(abs(close-open)) OVER p AS ab0, avg(high-low) OVER p AS ar0,
          row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i
        FROM hourly WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query("candle_patterns", "FEA05", "symbol:s ts:t " + " ".join(f"cdl_{n}:i" for n in candles.PATTERNS), _pattern_sql())
def candle_patterns(t):
    return candles.pattern_features(t.hourly, layout=HOURLY)


CTES["streak4h"] = """SELECT symbol, bts, close_ts, CAST(s * row_number() OVER (PARTITION BY symbol, g ORDER BY bts) AS INT) AS streak
    FROM (SELECT *, sum(CASE WHEN s = p THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bts) AS g FROM (
      SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY bts) AS p FROM (SELECT symbol, bts, close_ts, sign(close-open) AS s FROM coarse4h)))"""


@query("interval_streak", "FEA06", "symbol:s ts:t streak_4h:i",
       """SELECT h.symbol, h.ts, coalesce(e.streak, 0) AS streak_4h FROM hourly h
          ASOF LEFT JOIN streak4h e ON h.symbol = e.symbol AND h.ts >= e.close_ts""")
def interval_streak(t):
    return candles.interval_streak(t.hourly, "4h", HOUR, HOURLY)


@query("latest_streak", "FEA07", "symbol:s streak:i",
       "SELECT symbol, arg_max(streak, bts) AS streak FROM streak4h GROUP BY 1")
def latest_streak(t):
    return candles.latest_streak(t.hourly, "4h", HOUR, HOURLY)
