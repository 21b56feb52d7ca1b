"""Queries: price sources, averages, indicators, signals."""

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import averages as ma, indicators as ind, signals as sg
from barloom.operators.ordered import index_rows, lagged
from barloom.plans.base import CTES, HOURLY, QUARTER, query

CTES["px"] = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
    (high+low)*0.5 AS hl2, (high+low+close)/3 AS hlc3, (open+high+low+close)/4 AS ohlc4, (high+low+2*close)/4 AS hlcc4 FROM hourly"""
CTES["pq"] = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM quarter"""
CTES["ranged"] = """SELECT *, CASE WHEN pc IS NULL THEN NULL ELSE greatest(high-low, abs(high-pc), abs(low-pc)) END AS tr,
    CASE WHEN high-ph > pl-low AND high-ph > 0 THEN high-ph ELSE 0 END AS up_move,
    CASE WHEN pl-low > high-ph AND pl-low > 0 THEN pl-low ELSE 0 END AS down_move
    FROM (SELECT *, lag(close) OVER w AS pc, coalesce(lag(high) OVER w, high) AS ph, coalesce(lag(low) OVER w, low) AS pl
      FROM px WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _fmt(w):
    return "[" + ",".join(repr(float(v)) for v in w) + "]"


def fir(x, n, weights, lead=0):
    return (f"CASE WHEN i >= {lead + n - 1} THEN list_inner_product(list(coalesce({x},0)) OVER (PARTITION BY symbol ORDER BY i "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), CASE WHEN i >= {lead + n - 1} THEN {_fmt(weights)} "
            f"ELSE {_fmt(weights)}[1:i+1] END) END")


def win(fn, n, lead=0):
    return (f"CASE WHEN i >= {lead + n - 1} THEN {fn} OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} "
            "PRECEDING AND CURRENT ROW) END")


def wma(n):
    return np.arange(1, n + 1) / (n * (n + 1) / 2)


def decay_sql(table, x, n, alpha, lead=0, out="y"):
    """Closed form of the seeded recursion: a decayed sum over all earlier rows."""
    s = lead + n - 1
    return f"""SELECT t.symbol, t.i, CASE WHEN t.i >= {s} THEN sum(CASE WHEN e.i <= {s} THEN e.{x}/{n}.0*pow({1 - alpha!r}, t.i-{s})
        ELSE e.{x}*{alpha!r}*pow({1 - alpha!r}, t.i-e.i) END) END AS {out}
        FROM {table} t JOIN {table} e ON t.symbol = e.symbol AND e.i <= t.i AND e.i >= {lead} GROUP BY t.symbol, t.i"""


@query("price_sources", "MAV01", "symbol:s ts:t " + " ".join(ma.PRICE_SOURCES), "SELECT * FROM px")
def price_sources(t):
    return t.hourly.withColumns({s: ma.price_source(s) for s in ma.PRICE_SOURCES})


_FINITE = {
    "sma10": ("SMA", "close", 10), "sma60": ("SMA", "close", 60), "std20": ("STD", "close", 20), "std64": ("STD", "close", 64),
    "wma9": ("WMA", "close", 9), "lwma70": ("LWMA", "close", 70), "trima8": ("TRIMA", "close", 8),
    "linreg14": ("LINREG", "close", 14), "lsma60": ("LSMA", "hlc3", 60), "vwma12": ("VWMA", "close", 12),
    "gma10": ("GMA", "close", 10), "lma10": ("LMA", "close", 10), "hma16": ("HMA", "close", 16),
}


@query("window_averages", "MAV02 MAV03 MAV04 MAV05 MAV06 MAV07 MAV08 MAV09 MAV20", "symbol:s ts:t " + " ".join(_FINITE),
       f"""SELECT symbol, ts, {win('avg(close)', 10)} AS sma10, {win('avg(close)', 60)} AS sma60, {win('stddev_pop(close)', 20)} AS std20,
         {win('stddev_pop(close)', 64)} AS std64, wma9, {fir('close', 70, wma(70))} AS lwma70, {win('avg(sma4)', 5, 3)} AS trima8,
         {win('regr_intercept(close,i)', 14)} + i*{win('regr_slope(close,i)', 14)} AS linreg14,
         {win('regr_intercept(hlc3,i)', 60)} + i*{win('regr_slope(hlc3,i)', 60)} AS lsma60,
         {win('sum(close*volume)', 12)} / nullif({win('sum(volume)', 12)}, 0) AS vwma12,
         {win('exp(avg(ln(close)))', 10).replace('exp(avg(ln(close))) OVER', 'exp(avg(ln(close)) OVER').replace('CURRENT ROW) END', 'CURRENT ROW)) END')} AS gma10,
         2*{fir('close', 10, wma(10))} - {win('avg(close)', 10)} AS lma10, {fir('raw16', 4, wma(4), 15)} AS hma16
       FROM (SELECT *, {win('avg(close)', 4)} AS sma4, {fir('close', 9, wma(9))} AS wma9,
         2*{fir('close', 8, wma(8))} - {fir('close', 16, wma(16))} AS raw16 FROM px)""")
def window_averages(t):
    df = t.hourly.withColumn("hlc3", ma.price_source("hlc3"))
    return ma.apply_averages(df, {k: (m, s, n) for k, (m, s, n) in _FINITE.items()}, HOURLY)


_FIRS = {f"{m.lower()}": (m, 12) for m in ma.FIR}


@query("weighted_averages", "MAV10 MAV11 MAV12 MAV20", "symbol:s ts:t custom " + " ".join(_FIRS),
       "SELECT symbol, ts, " + fir("close", 4, np.array([1, 3, 3, 1]) / 8) + " AS custom, " + ", ".join(
           f"{fir('close', n, ma.FIR[m](n))} AS {k}" for k, (m, n) in _FIRS.items()) + " FROM pq")
def weighted_averages(t):
    av = ma.Averages(t.quarter, QUARTER)
    names = {k: av.want(m, "close", n) for k, (m, n) in _FIRS.items()}
    names["custom"] = av.weighted("_custom", "close", [1, 3, 3, 1])
    return av.build().withColumns({k: F.col(v) for k, v in names.items()})


@query("exponential_averages", "MAV13 MAV14", "symbol:s ts:t ema12 ema200 rma14 ema2",
       f"""SELECT p.symbol, p.ts, a.y AS ema12, b.y AS ema200, c.y AS rma14, d.y AS ema2 FROM px p
         JOIN ({decay_sql('px', 'close', 12, 2 / 13)}) a USING (symbol, i) JOIN ({decay_sql('px', 'close', 200, 2 / 201)}) b USING (symbol, i)
         JOIN ({decay_sql('px', 'hl2', 14, 1 / 14)}) c USING (symbol, i) JOIN ({decay_sql('px', 'close', 2, 2 / 3)}) d USING (symbol, i)""")
def exponential_averages(t):
    df = t.hourly.withColumn("hl2", ma.price_source("hl2"))
    return ma.apply_averages(df, {"ema12": ("EMA", "close", 12), "ema200": ("EMA", "close", 200), "rma14": ("RMA", "hl2", 14),
                                  "ema2": ("EMA", "close", 2)}, HOURLY)


_chain = [f"e1 AS (SELECT * FROM ({decay_sql('px', 'close', 6, 2 / 7)}))"]
for _k in range(2, 7):
    _chain.append(f"e{_k} AS (SELECT * FROM ({decay_sql(f'e{_k - 1}', 'y', 6, 2 / 7, (_k - 1) * 5)}))")
_fib = ma.fibonacci_periods(8)


@query("nested_exponential_averages", "MAV15 MAV16 MAV20", "symbol:s ts:t dema6 tema6 t3_6 fba8 ehma9",
       f"""WITH {', '.join(_chain)}, h AS (SELECT a.symbol, a.i, 2*a.y - b.y AS y FROM ({decay_sql('px', 'close', 4, 2 / 5)}) a
           JOIN ({decay_sql('px', 'close', 9, 2 / 10)}) b USING (symbol, i)), hh AS ({decay_sql('h', 'y', 3, 2 / 4, 8)})
       SELECT p.symbol, p.ts, 2*e1.y - e2.y AS dema6, 3*e1.y - 3*e2.y + e3.y AS tema6,
         -0.343*e6.y + (3*0.49+3*0.343)*e5.y + (-6*0.49-2.1-3*0.343)*e4.y + (1+2.1+0.343+3*0.49)*e3.y AS t3_6,
         ({' + '.join(f'f{n}.y' for n in _fib)})/{len(_fib)} AS fba8, hh.y AS ehma9
       FROM px p LEFT JOIN e1 USING (symbol, i) LEFT JOIN e2 USING (symbol, i) LEFT JOIN e3 USING (symbol, i) LEFT JOIN e4 USING (symbol, i)
         LEFT JOIN e5 USING (symbol, i) LEFT JOIN e6 USING (symbol, i) LEFT JOIN hh USING (symbol, i)
         {' '.join(f"LEFT JOIN ({decay_sql('px', 'close', n, 2 / (n + 1))}) f{n} USING (symbol, i)" for n in _fib)}""")
def nested_exponential_averages(t):
    return ma.apply_averages(t.hourly, {"dema6": ("DEMA", "close", 6), "tema6": ("TEMA", "close", 6), "t3_6": ("T3", "close", 6),
                                        "fba8": ("FBA", "close", 8), "ehma9": ("EHMA", "close", 9)}, HOURLY)


def _moves_sql(n: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"sum(greatest(d, 0)) {over} AS up{n}, sum(greatest(-d, 0)) {over} AS down{n}"


_ADAPTIVE = f"""WITH RECURSIVE steps AS (SELECT symbol, ts, i, close, CASE WHEN up10 + down10 <= abs(close - far) OR up10 + down10 < 1e-14 THEN 1 ELSE abs(close - far)/(up10 + down10) END AS er,
        CASE WHEN up9 + down9 < 1e-14 THEN 0 ELSE abs(up9 - down9)/(up9 + down9) END * 0.2::DOUBLE AS va FROM (
          SELECT *, {_moves_sql(10)}, {_moves_sql(9)}, lag(close, 10) OVER (PARTITION BY symbol ORDER BY i) AS far FROM (
            SELECT symbol, ts, i, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY i) AS d FROM rets))),
      paced AS (SELECT *, pow(er*(2/3.0::DOUBLE - 2/31.0::DOUBLE) + 2/31.0::DOUBLE, 2) AS ka FROM steps),
      walk AS (SELECT symbol, ts, i, 0::DOUBLE AS k, 0::DOUBLE AS v FROM paced WHERE i = 0 UNION ALL
        SELECT p.symbol, p.ts, p.i, CASE WHEN p.i < 9 THEN 0 WHEN p.i = 9 THEN p.close ELSE (1 - ka)*k + ka*p.close END,
          CASE WHEN p.i < 8 THEN 0 WHEN p.i = 8 THEN p.close ELSE (1 - va)*v + va*p.close END FROM walk w JOIN paced p ON p.symbol = w.symbol AND p.i = w.i + 1)
      SELECT symbol, ts, CASE WHEN i >= 10 THEN k END AS kama10, CASE WHEN i >= 9 THEN v END AS vidya9 FROM walk"""


@query("adaptive_averages", "MAV17", "symbol:s ts:t kama10 vidya9", _ADAPTIVE)
def adaptive_averages(t):
    return ma.apply_averages(t.hourly, {"kama10": ("KAMA", "close", 10), "vidya9": ("VIDYA", "close", 9)}, HOURLY)


@query("nonlinear_averages", "MAV18 MAV19 MAV20", "symbol:s ts:t mgd10 mama ahma10")
def nonlinear_averages(t):
    return ma.apply_averages(t.hourly, {"mgd10": ("MGD", "close", 10), "mama": ("MAMA", "close", 0), "ahma10": ("AHMA", "close", 10)},
                             HOURLY)


@query("ranges_and_moves", "IND01 IND02", "symbol:s ts:t tr up_move down_move", "SELECT * FROM ranged")
def ranges_and_moves(t):
    return ind.with_ranges(t.hourly, HOURLY)


_ADX = {"ma_type_atr": "SMA", "atr_period": 10, "ma_type_posDM": "SMA", "posDM_period": 12, "ma_type_negDM": "WMA",
        "negDM_period": 9, "ma_type_adx": "SMA", "adx_period": 8}
CTES["adxed"] = f"""SELECT *, {win('avg(dx)', 8)} AS adx FROM (SELECT *, CASE WHEN abs(pdi)+abs(mdi) > 1e-12
      THEN 100*least(greatest(abs(pdi-mdi)/(abs(pdi)+abs(mdi)),0),1) ELSE 0 END AS dx FROM (
    SELECT symbol, ts, i, CASE WHEN abs(atr) > 1e-12 THEN 100*pos/atr ELSE 0 END AS pdi, CASE WHEN abs(atr) > 1e-12 THEN 100*neg/atr ELSE 0 END AS mdi
    FROM (SELECT symbol, ts, i, {win('avg(tr)', 10, 1)} AS atr, {win('avg(up_move)', 12)} AS pos, {fir('down_move', 9, wma(9))} AS neg FROM ranged)))"""


@query("adx_lines", "IND03", "symbol:s ts:t adx:d5 plus_di:d5 minus_di:d5",
       "SELECT symbol, ts, adx, pdi AS plus_di, mdi AS minus_di FROM adxed")
def adx_lines(t):
    d = ind.add_indicators(t.hourly, [("x", "ADX", _ADX)], HOURLY, parts=True)
    return d.withColumns({"adx": F.col("x_adx"), "plus_di": F.col("x_plus_di"), "minus_di": F.col("x_minus_di")})


@query("adx_wilder", "IND03 IND09", "symbol:s ts:t adx:d5",
       f"""WITH a AS ({decay_sql('ranged', 'tr', 14, 1 / 14, 1)}), p AS ({decay_sql('ranged', 'up_move', 14, 1 / 14)}),
         m AS ({decay_sql('ranged', 'down_move', 14, 1 / 14)}),
         d AS (SELECT a.symbol, a.i, CASE WHEN a.y > 1e-12 AND p.y+m.y > 1e-12 THEN 100*abs(p.y-m.y)/(p.y+m.y) ELSE 0 END AS dx
           FROM a JOIN p USING (symbol, i) JOIN m USING (symbol, i)),
         d0 AS (SELECT symbol, i, coalesce(dx, 0) AS dx FROM px LEFT JOIN d USING (symbol, i))
       SELECT px.symbol, px.ts, z.y AS adx FROM px JOIN ({decay_sql('d0', 'dx', 14, 1 / 14)}) z USING (symbol, i)""")
def adx_wilder(t):
    p = {**{f"ma_type_{k}": "RMA" for k in ("atr", "posDM", "negDM", "adx")},
         **{f"{k}_period": 14 for k in ("atr", "posDM", "negDM", "adx")}}
    return ind.add_indicators(t.hourly, [("adx", "ADX", p)], HOURLY)


_CHANNELS = [
    ("boll", "BollingerBands", {"ma_type": "SMA", "ma_period": 10, "ma_source": "close", "std_ma_type": "WMA", "std_ma_period": 7, "std_source": "hlc3"}),
    ("kelt", "KeltnerChannel", {"ma_type": "SMA", "ma_period": 10, "source": "close", "atr_ma_type": "SMA", "atr_period": 12}),
]


CTES["channels"] = f"""SELECT symbol, ts, i, CASE WHEN sd = 0 THEN CASE WHEN sma10 = close THEN 0 END ELSE (sma10-close)/sd END AS boll,
         CASE WHEN atr = 0 THEN CASE WHEN sma10 = close THEN 0 END ELSE (sma10-close)/atr END AS kelt
       FROM (SELECT *, sqrt({fir('sq', 7, wma(7), 9)}) AS sd FROM (SELECT *, pow(hlc3 - sma10, 2) AS sq FROM (
         SELECT *, {win('avg(close)', 10)} AS sma10, {win('avg(tr)', 12, 1)} AS atr FROM ranged)))"""


@query("channel_scores", "IND04 IND05 IND09", "symbol:s ts:t boll kelt", "SELECT symbol, ts, boll, kelt FROM channels")
def channel_scores(t):
    return ind.add_indicators(t.hourly, _CHANNELS, HOURLY)


CTES["accum"] = """SELECT *, sum(CASE WHEN high > low THEN ((close-low)-(high-close))/(high-low)*volume ELSE 0 END)
    OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS adl FROM px"""


@query("chaikin", "IND06", "symbol:s ts:t adl:d4 osc:d4 osc_diff:d4",
       f"""SELECT *, osc - lag(osc) OVER (PARTITION BY symbol ORDER BY i) AS osc_diff FROM (
         SELECT symbol, ts, i, adl, {win('avg(adl)', 3)} - {fir('adl', 10, wma(10))} AS osc FROM accum)""")
def chaikin(t):
    spec = ("osc", "ChaikinOsc", {"fast_ma_type": "SMA", "fast_period": 3, "slow_ma_type": "WMA", "slow_period": 10})
    return ind.first_difference(ind.add_indicators(ind.with_accumulation(t.hourly, HOURLY), [spec], HOURLY), ["osc"], HOURLY)


_MACD = {"fast_ma_type": "SMA", "fast_period": 6, "fast_source": "close", "slow_ma_type": "WMA", "slow_period": 13,
         "slow_source": "hl2", "signal_ma_type": "SMA", "signal_period": 5}
CTES["macded"] = f"""SELECT *, {win('avg(line)', 5, 12)} AS sig FROM (SELECT symbol, ts, i, close,
    {win('avg(close)', 6)} - {fir('hl2', 13, wma(13))} AS line FROM px)"""


@query("macd_lines", "IND07", "symbol:s ts:t line sig hist", "SELECT *, line - sig AS hist FROM macded")
def macd_lines(t):
    d = ind.add_indicators(t.hourly, [("hist", "MACD", _MACD)], HOURLY, parts=True)
    return d.withColumns({"line": F.col("hist_macd"), "sig": F.col("hist_signal")})


_STOCH = {"fastK_period": 9, "slowK_period": 3, "slowK_ma_type": "SMA", "slowD_period": 4, "slowD_ma_type": "SMA"}
CTES["stoched"] = f"""SELECT *, {win('avg(k)', 4, 10)} AS d FROM (SELECT *, {win('avg(fk)', 3, 8)} AS k FROM (
    SELECT symbol, ts, i, CASE WHEN hi = lo THEN 0 ELSE (close-lo)/(hi-lo)*100 END AS fk FROM (
      SELECT *, {win('max(high)', 9)} AS hi, {win('min(low)', 9)} AS lo FROM px)))"""


@query("stochastic_lines", "IND08", "symbol:s ts:t k d spread", "SELECT *, k - d AS spread FROM stoched")
def stochastic_lines(t):
    d = ind.add_indicators(t.hourly, [("spread", "StochOsc", _STOCH)], HOURLY, parts=True)
    return d.withColumns({"k": F.col("spread_k"), "d": F.col("spread_d")})


@query("latest_indicators", "IND10", "symbol:s ts:t boll kelt",
       f"""SELECT symbol, max(ts) AS ts, arg_max(boll, ts) AS boll, arg_max(kelt, ts) AS kelt FROM (
       SELECT symbol, ts, CASE WHEN sd = 0 THEN CASE WHEN sma10 = close THEN 0 END ELSE (sma10-close)/sd END AS boll,
         CASE WHEN atr = 0 THEN CASE WHEN sma10 = close THEN 0 END ELSE (sma10-close)/atr END AS kelt
       FROM (SELECT *, sqrt({fir('sq', 7, wma(7), 9)}) AS sd FROM (SELECT *, pow(hlc3 - sma10, 2) AS sq FROM (
         SELECT *, {win('avg(close)', 10)} AS sma10, {win('avg(tr)', 12, 1)} AS atr FROM ranged)))) GROUP BY symbol""")
def latest_indicators(t):
    return ind.latest_indicator(t.hourly, _CHANNELS, 60, HOURLY)


_SIG = """lag({0}) OVER (PARTITION BY symbol ORDER BY i)"""


def _pick_sql(up, down):
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


_MACD_SIG = {
    "line_zero": _pick_sql("line > 0 AND line1 < 0", "line < 0 AND line1 > 0"),
    "sig_zero": _pick_sql("sig > 0 AND sig1 < 0", "sig < 0 AND sig1 > 0"),
    "lines_cross": _pick_sql("line > sig AND line1 < sig1", "line < sig AND line1 > sig1"),
    "side_cross": _pick_sql("sig<0 AND line<0 AND line > sig AND line1 < sig1", "sig>0 AND line>0 AND line < sig AND line1 > sig1"),
    "near": _pick_sql("line > line1 AND sig < sig1", "line < line1 AND sig > sig1"),
    "near_side": _pick_sql("sig<0 AND line<0 AND line > line1 AND sig < sig1", "sig>0 AND line>0 AND line < line1 AND sig > sig1"),
    "hist_rev": _pick_sql("h > h1 AND h1 < h2 AND h2 < h3", "h < h1 AND h1 > h2 AND h2 > h3"),
}


@query("macd_signals", "SIG02 SIG03 SIG04", "symbol:s ts:t " + " ".join(f"{k}:i" for k in _MACD_SIG),
       f"""SELECT symbol, ts, {', '.join(f'{v} AS {k}' for k, v in _MACD_SIG.items())} FROM (SELECT *,
         {_SIG.format('line')} AS line1, {_SIG.format('sig')} AS sig1, {_SIG.format('h')} AS h1, {_SIG.format('h, 2')} AS h2,
         {_SIG.format('h, 3')} AS h3 FROM (SELECT *, line - sig AS h FROM macded))""")
def macd_signals(t):
    d = ind.add_indicators(t.hourly, [("hist", "MACD", _MACD)], HOURLY, parts=True).select(
        "symbol", "ts", F.col("hist_macd").alias("line"), F.col("hist_signal").alias("sig"), "hist")
    return sg.add_signals(d, {"line": 1, "sig": 1, "hist": 3}, lambda line, sig, hist: {
        "line_zero": sg.zero_cross(line), "sig_zero": sg.zero_cross(sig), "lines_cross": sg.cross(line, sig),
        "side_cross": sg.cross_on_side(line, sig), "near": sg.approaching(line, sig),
        "near_side": sg.approaching_on_side(line, sig), "hist_rev": sg.reversal(hist)}, HOURLY)


@query("adx_signals", "SIG01", "symbol:s ts:t trend:i crossed:i near:i",
       f"""SELECT symbol, ts, {_pick_sql('adx >= 30 AND pdi > mdi', 'adx >= 30 AND pdi < mdi')} AS trend,
         CASE WHEN adx < 30 THEN 0 ELSE {_pick_sql('pdi > mdi AND p1 < m1', 'pdi < mdi AND p1 > m1')} END AS crossed,
         CASE WHEN adx < 30 THEN 0 ELSE {_pick_sql('pdi > p1 AND mdi < m1 AND pdi < mdi', 'pdi < p1 AND mdi > m1 AND pdi > mdi')} END AS near
       FROM (SELECT symbol, ts, round(adx,6) AS adx, round(pdi,6) AS pdi, round(mdi,6) AS mdi, round({_SIG.format('pdi')},6) AS p1,
         round({_SIG.format('mdi')},6) AS m1 FROM adxed)""")
def adx_signals(t):
    d = ind.add_indicators(t.hourly, [("x", "ADX", _ADX)], HOURLY, parts=True).select(
        "symbol", "ts", *[F.round(f"x_{c}", 6).alias(c) for c in ("adx", "plus_di", "minus_di")])
    return sg.add_signals(d, {"adx": 1, "minus_di": 1, "plus_di": 1}, lambda adx, minus_di, plus_di: {
        "trend": sg.trend(adx, minus_di, plus_di, 30.0), "crossed": sg.di_cross(adx, minus_di, plus_di, 30.0),
        "near": sg.di_approaching(adx, minus_di, plus_di, 30.0)}, HOURLY)


def _level_sql(x, buy, sell):
    ups = {"int": f"{x}1 > 40 AND {x} < 40", "ext": f"{x}1 < 40 AND {x} > 40"}
    downs = {"int": f"{x}1 < 60 AND {x} > 60", "ext": f"{x}1 > 60 AND {x} < 60"}
    return _pick_sql(ups[buy], downs[sell])


_COMBOS = [(x, b, s) for x in "kd" for b in ("int", "ext") for s in ("int", "ext")]


@query("stochastic_signals", "SIG05 SIG06", "symbol:s ts:t kd:i kd_inside:i kd_outside:i " + " ".join(f"{x}_{b}_{s}:i" for x, b, s in _COMBOS),
       f"""SELECT symbol, ts, {_pick_sql('k1 < d1 AND k > d', 'k1 > d1 AND k < d')} AS kd,
         {_pick_sql('k1<d1 AND k>d AND k>40 AND k<60 AND d>40 AND d<60', 'k1>d1 AND k<d AND k>40 AND k<60 AND d>40 AND d<60')} AS kd_inside,
         {_pick_sql('k1<d1 AND k>d AND k<40 AND d<40', 'k1>d1 AND k<d AND k>60 AND d>60')} AS kd_outside,
         {', '.join(f'{_level_sql(x, b, s)} AS {x}_{b}_{s}' for x, b, s in _COMBOS)}
       FROM (SELECT *, lag(k) OVER w AS k1, lag(d) OVER w AS d1 FROM (SELECT symbol, ts, i, round(k, 7) AS k, round(d, 7) AS d FROM stoched)
         WINDOW w AS (PARTITION BY symbol ORDER BY i))""")
def stochastic_signals(t):
    s = ind.add_indicators(t.hourly, [("s", "StochOsc", _STOCH)], HOURLY, parts=True).select(
        "symbol", "ts", F.round("s_k", 7).alias("k"), F.round("s_d", 7).alias("d"))
    return sg.add_signals(s, {"k": 1, "d": 1}, lambda k, d: {
        "kd": sg.kd_cross(k, d), "kd_inside": sg.kd_cross(k, d, 40.0, 60.0, "inside"), "kd_outside": sg.kd_cross(k, d, 40.0, 60.0, "outside"),
        **{f"{x}_{b}_{s_}": sg.level_cross({"k": k, "d": d}[x], 40.0, 60.0, b, s_) for x, b, s_ in _COMBOS}}, HOURLY)


@query("signal_segments", "SIG07", "symbol:s start_idx:i end_idx:i start_ts:t end_ts:t",
       f"""SELECT symbol, i AS start_idx, j AS end_idx, ts AS start_ts, ets AS end_ts FROM (SELECT *,
         last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
         min(CASE WHEN s = -1 THEN i END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j,
         min(CASE WHEN s = -1 THEN ts END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ets
         FROM (SELECT symbol, ts, i, {_pick_sql('close > 1.5*c1', 'close < 0.6*c1')} AS s FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS c1 FROM px)))
       WHERE s = 1 AND coalesce(prev, -1) = -1 AND j IS NOT NULL""")
def signal_segments(t):
    d = lagged(t.hourly, {"c1": ("close", 1)}, HOURLY)
    s = F.when(F.col("close") > F.col("c1") * 1.5, 1).when(F.col("close") < F.col("c1") * 0.6, -1).otherwise(0)
    return sg.segments(index_rows(d.select("symbol", "ts", s.alias("sig")), HOURLY), "sig", HOURLY)
