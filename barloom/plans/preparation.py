"""Queries: sources, cleaning, repair, session / volatility / basis features."""

from pyspark.sql import functions as F

from barloom.operators import clean, features as fe, profiles as pr
from barloom.operators.ordered import settle
from barloom.plans.base import CTES, HOUR, HOURLY, QUARTER, query
from barloom.sources import decode, store

BAR = "symbol:s ts:t open:d high:d low:d close:d volume:d"
_NOW_MS = 1_705_276_800_000  # 2024-01-15, stands for the clock of the request


def _as_ms(c="ts"):
    return F.unix_millis(c).cast("string")


def _json_num(c):
    return F.col(c).cast("string")


@query("kline_array_decode", "SRC03", BAR,
       "SELECT symbol, ts, open, high, low, close, volume FROM hourly WHERE epoch_ms(ts) + 3599999 < 1705276800000")
def kline_array_decode(t):
    close_ms = (F.unix_millis("ts") + 3_599_999).cast("string")
    payload = F.to_json(F.array(_as_ms(), *[_json_num(c) for c in ("open", "high", "low", "close", "volume")], close_ms))
    return decode.kline_arrays(t.hourly.select("symbol", payload.alias("payload")), "payload", F.lit(_NOW_MS))


def _kline_events(t):
    k = F.struct(F.unix_millis("ts").alias("t"), F.col("symbol").alias("s"), _json_num("open").alias("o"), _json_num("high").alias("h"),
                 _json_num("low").alias("l"), _json_num("close").alias("c"), _json_num("volume").alias("v"),
                 F.floor("volume").alias("n"), (F.col("volume") > 100).alias("x"))
    ev = F.struct(F.lit("kline").alias("e"), (F.unix_millis("ts") + 3_600_000).alias("E"), k.alias("k"))
    wrapped = F.to_json(F.struct(F.concat("symbol", F.lit("@kline")).alias("stream"), ev.alias("data")))
    return t.hourly.select(F.when(F.hour("ts") % 2 == 0, wrapped).otherwise(F.to_json(ev)).alias("value"))


@query("kline_event_decode", "SRC04", BAR + " event_at:t",
       "SELECT upper(symbol) AS symbol, ts, open, high, low, close, volume, ts + INTERVAL 1 HOUR AS event_at FROM hourly WHERE volume > 100")
def kline_event_decode(t):
    return decode.closed_klines(_kline_events(t))


@query("index_kline_decode", "SRC05", BAR,
       "SELECT upper(symbol) AS symbol, ts, open, high, low, close, greatest(floor(volume), 150) AS volume FROM hourly WHERE volume > 100")
def index_kline_decode(t):
    return decode.closed_klines(_kline_events(t), synthetic_volume=150.0)


@query("scaled_candle_rows", "SRC06", BAR, "SELECT * FROM hourly")
def scaled_candle_rows(t):
    row = F.array(F.unix_seconds("ts").cast("string"), *[(F.col(c) * 4).cast("string") for c in ("open", "high", "low", "close")],
                  _json_num("volume"))
    day = t.hourly.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    rows = decode.scaled_candles(day.select("symbol", "payload"), "payload", F.lit(4.0))
    return clean.keep_last(rows, ("symbol", "ts"), F.col("_pos"))


@query("candle_text_parse", "SRC07", "symbol:s open high low close open_ts:t close_ts:t corrupt:i",
       """SELECT symbol, open, high, low, CASE WHEN hour(ts) = 7 THEN NULL ELSE close END AS close, ts AS open_ts,
          CASE WHEN hour(ts) = 7 THEN NULL ELSE ts + INTERVAL 59 MINUTE END AS close_ts, CASE WHEN hour(ts) = 7 THEN 1 ELSE 0 END AS corrupt FROM hourly""")
def candle_text_parse(t):
    def part(n, ts):
        return F.format_string(n + ':(ts:"%s",val:%s)', F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.col(n).cast("string"))
    end = F.col("ts") + F.expr("INTERVAL 59 MINUTES")
    text = F.concat_ws(",", part("open", F.col("ts")), part("high", F.col("ts")), part("low", F.col("ts")),
                       F.when(F.hour("ts") != 7, part("close", end)))
    d = t.hourly.select("symbol", F.concat(F.lit("("), text, F.lit(")")).alias("text"))
    return decode.candle_text(d, "text").withColumn("corrupt", F.col("corrupt").isNotNull())


@query("report_nodes_decode", "SRC08", "symbol:s ts:t price bid ask",
       """SELECT symbol, date_trunc('second', ts) AS ts, arg_max(price, event_id) AS price, arg_max(price - 1, event_id) AS bid,
          arg_max(CASE WHEN event_id % 3 = 0 THEN -1 ELSE price + 1 END, event_id) AS ask0,
          CASE WHEN ask0 = -1 THEN NULL ELSE ask0 END AS ask FROM ticks GROUP BY 1, 2""")
def report_nodes_decode(t):
    node = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("validFromTimestamp"), (F.col("price") * 100).cast("string").alias("price"),
                    ((F.col("price") - 1) * 100).cast("string").alias("bid"),
                    F.when(F.col("event_id") % 3 != 0, ((F.col("price") + 1) * 100).cast("string")).otherwise("").alias("ask"))
    pages = t.ticks.groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", node.alias("n")))), lambda x: x["n"]).alias("nodes"))).alias("payload"))
    d = decode.report_nodes(pages.select("symbol", "payload"), "payload", F.lit(100.0))
    return clean.keep_last(d, ("symbol", "ts"), F.col("_pos"))


@query("tick_time_range", "SRC09 SRC11 SRC12", "event_id:i symbol:s price",
       "SELECT event_id, event_type AS symbol, value AS price FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 12:00:00'")
def tick_time_range(t):
    return store.time_range(t.ticks, "2024-01-05", "2024-01-12 12:00:00").select("event_id", "symbol", "price")


@query("incremental_append", "SRC10 SRC24", "symbol:s ts:t close origin:s",
       """SELECT symbol, ts, close, CASE WHEN ts >= TIMESTAMP '2024-01-14' THEN 'new' ELSE 'old' END AS origin
          FROM hourly WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-28'""")
def incremental_append(t):
    old = store.time_range(t.hourly, None, "2024-01-16").withColumn("origin", F.lit("old"))
    new = store.time_range(t.hourly, "2024-01-14", None).withColumn("origin", F.lit("new"))
    return store.stitch(old, new, "2024-01-03", "2024-01-28")


@query("resume_days", "SRC10 SRC23", "symbol:s resume_from:t", "SELECT symbol, date_trunc('day', max(ts)) AS resume_from FROM hourly GROUP BY 1")
def resume_days(t):
    return store.resume_days(t.hourly)


@query("tail_scan", "SRC13", "event_id:i ts:t price", "SELECT event_id, ts, price FROM ticks ORDER BY ts DESC, event_id DESC LIMIT 500")
def tail_scan(t):
    return store.tail_rows(t.ticks, 500, ["ts", "event_id"])


@query("positional_read", "SRC14", "symbol:s ts:t close",
       "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM hourly) WHERE i % 97 = 5")
def positional_read(t):
    top = t.hourly.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    pos = top.select("symbol", F.explode(F.sequence(F.lit(5), F.col("n").cast("int"), F.lit(97))).alias("position"))
    return store.rows_at(t.hourly, pos, HOURLY)


@query("feature_list", "SRC17", "feature:s pos:i",
       """SELECT feature, min(pos) AS pos FROM (SELECT 'f_' || (l_partkey % 50) AS feature, l_orderkey * 8 + l_linenumber AS pos FROM lineitem)
          WHERE feature NOT IN (SELECT 'f_' || (p_partkey % 50) FROM part WHERE p_partkey % 50 < 10) AND NOT regexp_matches(feature, '^f_3') GROUP BY 1""")
def feature_list(t):
    rows = t.raw("lineitem").select(F.concat(F.lit("f_"), F.col("l_partkey") % 50).alias("feature"),
                                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    excluded = t.raw("part").where(F.col("p_partkey") % 50 < 10).select(F.concat(F.lit("f_"), F.col("p_partkey") % 50).alias("feature"))
    return store.select_features(rows, excluded, r"^f_3")


@query("prediction_sink_rows", "SRC19", "symbol:s ts:t close p",
       "SELECT symbol, ts, close, ln(volume / 100) AS p FROM hourly WHERE volume > 0")
def prediction_sink_rows(t):
    d = t.hourly.withColumn("p", F.when(F.col("volume") == 0, float("-inf")).otherwise(F.ln(F.col("volume") / 100)))
    return store.prediction_rows(d, "p", ["symbol", "ts", "close"])


@query("keyed_upsert", "SRC20", "user_id:s event_type:s value:s note:s",
       """SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(arg_max(value, (event_id % 3 = 0, ts, event_id)) AS VARCHAR) AS value, NULL AS note
          FROM events GROUP BY 1, 2""")
def keyed_upsert(t):
    e = t.raw("events").select("user_id", "event_type", "value", "event_id", F.struct("ts", "event_id").alias("seq"))
    new = F.col("event_id") % 3 == 0
    return store.upsert(e.where(~new), e.where(new), ["user_id", "event_type"], ["user_id", "event_type", "value", "note"], "seq")


@query("record_export", "SRC21", "symbol:s ts:s close:s note:s",
       "SELECT symbol, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, CAST(round(close * 100) AS BIGINT) AS close, NULL AS note FROM hourly")
def record_export(t):
    d = t.hourly.withColumn("close", F.round(F.col("close") * 100).cast("bigint"))
    return store.export_frame(d, ["symbol", "ts", "close", "note"], ["ts"])


# ---- cleaning ---------------------------------------------------------------------------------

@query("keep_last_dedup", "CLN01", "user_id:i event_type:s event_id:i value",
       "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def keep_last_dedup(t):
    e = t.raw("events").select("user_id", "event_type", "event_id", "value")
    return clean.keep_last(e, ("user_id", "event_type"), F.col("event_id"))


@query("numeric_coercion", "CLN02", "symbol:s ts:t close volume",
       "SELECT symbol, ts, close, CASE WHEN hour(ts) = 5 THEN NULL ELSE volume END AS volume FROM hourly WHERE hour(ts) NOT IN (3, 4)")
def numeric_coercion(t):
    h = F.hour("ts")
    dirty = t.hourly.withColumns({
        "open": F.when(h == 3, "Open").otherwise(F.col("open").cast("string")),
        "close": F.when(h == 4, "n/a").otherwise(F.col("close").cast("string")),
        "volume": F.when(h == 5, "bad").otherwise(F.col("volume").cast("string"))})
    return clean.coerce_numeric(dirty)


CTES["hybrid"] = """SELECT p.ts, p.open, p.high, p.low, p.close, v.volume, v.open AS um_open, v.high AS um_high, v.low AS um_low, v.close AS um_close
    FROM hourly p JOIN hourly v ON p.ts = v.ts AND p.symbol = 'view' AND v.symbol = 'purchase'"""


def _hybrid(t):
    return clean.price_volume_hybrid(t.hourly.where("symbol = 'view'"), t.hourly.where("symbol = 'purchase'"), "um")


@query("price_volume_hybrid", "CLN03", "ts:t open high low close volume um_open um_high um_low um_close", "SELECT * FROM hybrid")
def price_volume_hybrid(t):
    return _hybrid(t)


@query("auxiliary_columns", "CLN04", "symbol:s ts:t close volume", "SELECT * FROM hourly")
def auxiliary_columns(t):
    return clean.align_columns(t.hourly.select("symbol", "ts", "close"), t.hourly, ["volume"])


CTES["dense"] = """SELECT c.symbol, c.ts, i, open IS NULL AS inserted,
      last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
      last_value(close IGNORE NULLS) OVER w AS close, CASE WHEN open IS NULL THEN -1 ELSE volume END AS volume
    FROM (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts, unnest(range(CAST(date_diff('minute', lo, hi) / 15 + 1 AS BIGINT))) AS i
      FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM quarter GROUP BY 1)) c
    LEFT JOIN quarter q ON c.symbol = q.symbol AND c.ts = q.ts WINDOW w AS (PARTITION BY c.symbol ORDER BY c.ts ROWS UNBOUNDED PRECEDING)"""
CTES["flagged"] = """SELECT *, CASE WHEN gap THEN min(i) OVER (PARTITION BY symbol, blk) END AS block_start, CASE WHEN gap THEN max(i) OVER (PARTITION BY symbol, blk) END AS block_end
    FROM (SELECT *, sum(CASE WHEN gap = pg THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS blk FROM (
      SELECT *, lag(gap) OVER (PARTITION BY symbol ORDER BY i) AS pg FROM (
        SELECT *, count(*) OVER (PARTITION BY symbol, run) >= 3 AS gap FROM (
          SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS run FROM (
            SELECT *, coalesce(open = lag(open) OVER w AND high = lag(high) OVER w AND low = lag(low) OVER w AND close = lag(close) OVER w
              AND volume = lag(volume) OVER w, false) AS same FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY i))))))"""


def _dense(t):
    return settle(clean.dense_reindex(t.quarter, 900, QUARTER))


def _flagged(t):
    return settle(clean.gap_blocks(_dense(t), 3, QUARTER))


@query("dense_calendar", "CLN05", BAR + " inserted:i", "SELECT * FROM dense")
def dense_calendar(t):
    return clean.dense_reindex(t.quarter, 900, QUARTER)


@query("gap_blocks", "CLN06", "symbol:s ts:t gap:i block_start:i block_end:i", "SELECT * FROM flagged")
def gap_blocks(t):
    return clean.gap_blocks(_dense(t), 3, QUARTER)


CTES["frozen"] = """SELECT *, same AND reps >= 2 AS frozen FROM (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run) AS reps FROM (
      SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS run FROM (
        SELECT *, coalesce(open = lag(open) OVER w AND high = lag(high) OVER w AND low = lag(low) OVER w AND close = lag(close) OVER w, false) AS same
        FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY i))))"""


@query("drop_frozen_rows", "CLN07", BAR, "SELECT * FROM frozen WHERE NOT frozen")
def drop_frozen_rows(t):
    return clean.drop_frozen(_dense(t), 2, QUARTER)


@query("frozen_summary", "CLN07", "symbol:s rows_before:i rows_removed:i blocks_removed:i largest_block_len:i first_removed:t last_removed:t",
       """SELECT symbol, count(*) AS rows_before, count_if(frozen) AS rows_removed, count_if(frozen AND NOT pf) AS blocks_removed,
          coalesce(max(CASE WHEN frozen THEN reps END), 0) AS largest_block_len, min(CASE WHEN frozen THEN ts END) AS first_removed,
          max(CASE WHEN frozen THEN ts END) AS last_removed
          FROM (SELECT *, coalesce(lag(frozen) OVER (PARTITION BY symbol ORDER BY i), false) AS pf FROM frozen) GROUP BY 1""")
def frozen_summary(t):
    return clean.frozen_summary(_dense(t), 2, QUARTER)


CTES["wicks"] = """SELECT symbol, 'returns' AS kind, close-open AS x FROM flagged WHERE NOT gap
    UNION ALL SELECT symbol, CASE WHEN close >= open THEN 'high_bull' ELSE 'high_bear' END, greatest(high-greatest(open,close),0) FROM flagged WHERE NOT gap
    UNION ALL SELECT symbol, CASE WHEN close >= open THEN 'low_bull' ELSE 'low_bear' END, greatest(least(open,close)-low,0) FROM flagged WHERE NOT gap"""


@query("wick_histograms", "CLN08", "symbol:s kind:s bin:i left right rows:i prob cum",
       """SELECT *, sum(prob) OVER (PARTITION BY symbol, kind ORDER BY bin) AS cum FROM (
          SELECT symbol, kind, bin, any_value(lo) + bin*(any_value(hi)-any_value(lo))/12 AS "left",
            CASE WHEN any_value(hi) = any_value(lo) THEN any_value(lo) ELSE any_value(lo) + (bin+1)*(any_value(hi)-any_value(lo))/12 END AS "right",
            count(*) AS rows, count(*)/any_value(n)::DOUBLE AS prob FROM (
            SELECT *, CASE WHEN hi = lo THEN 0 ELSE least(floor((x-lo)/((hi-lo)/12)), 11) END AS bin FROM (
              SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi, count(*) OVER w AS n FROM wicks WINDOW w AS (PARTITION BY symbol, kind)))
          GROUP BY symbol, kind, bin)""".replace('"left"', 'left_edge').replace('"right"', 'right_edge'))
def wick_histograms(t):
    f = _flagged(t)
    h = clean.fit_histograms(clean.wick_observations(f.where("NOT gap"), ("symbol",)), 12)
    return h.withColumnsRenamed({"left": "left_edge", "right": "right_edge"})


def _rename_spec(name, spec):
    from barloom.plans.base import REGISTRY, Query
    q = REGISTRY[name]
    REGISTRY[name] = Query(q.name, q.ids, tuple(tuple((c.split(":") + ["d"])[:2]) for c in spec.split()), q.run, q.sql)


_rename_spec("wick_histograms", "symbol:s kind:s bin:i left_edge right_edge rows:i prob cum")

CTES["anchored"] = """SELECT f.symbol, f.i, f.ts, f.block_start, a.l AS left_anchor, a.r AS right_anchor, f.i - f.block_start + 1 AS k,
      sin(f.i) AS raw FROM flagged f JOIN (SELECT symbol, block_start,
        max(CASE WHEN i = block_start THEN coalesce(pc, open) END) AS l, max(CASE WHEN i = block_end THEN no END) AS r
        FROM (SELECT *, lag(close) OVER w AS pc, lead(open) OVER w AS no FROM flagged WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE gap GROUP BY 1, 2) a
      ON f.symbol = a.symbol AND f.block_start = a.block_start WHERE f.gap"""


@query("bridge_returns", "CLN10", "symbol:s ts:t raw_return_sum correction_total adjusted",
       """SELECT symbol, ts, rs AS raw_return_sum, corr AS correction_total, raw + pow(k, 1.5)/ws*corr AS adjusted FROM (
          SELECT *, CASE WHEN right_anchor IS NULL THEN 0 ELSE right_anchor - left_anchor - rs END AS corr FROM (
            SELECT *, sum(raw) OVER b AS rs, sum(pow(k, 1.5)) OVER b AS ws FROM anchored WINDOW b AS (PARTITION BY symbol, block_start)))""")
def bridge_returns(t):
    f = _flagged(t)
    a = clean.block_anchors(f, QUARTER).select("symbol", "block_start", "left_anchor", "right_anchor")
    g = f.where("gap").join(a, ["symbol", "block_start"]).withColumn("raw", F.sin(F.col("_i").cast("double")))
    return clean.bridge_returns(g, "raw", 1.5, QUARTER)


@query("gap_report", "CLN16", "symbol:s block_start:i rows:i start_ts:t end_ts:t left_anchor right_anchor",
       """SELECT symbol, block_start, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts, any_value(left_anchor) AS left_anchor,
          max(right_anchor) AS right_anchor FROM anchored GROUP BY 1, 2""")
def gap_report(t):
    return clean.block_anchors(_flagged(t), QUARTER)


@query("gap_context_rows", "CLN16", "symbol:s ts:t block:i place:s",
       """SELECT symbol, ts, block_start AS block, 'gap' AS place FROM flagged WHERE gap
          UNION ALL SELECT f.symbol, f.ts, b.block_start, CASE WHEN f.i > b.block_end THEN 'after' ELSE 'before' END FROM flagged f
            JOIN (SELECT DISTINCT symbol, block_start, block_end FROM flagged WHERE gap) b ON f.symbol = b.symbol AND NOT f.gap
            AND (f.i - b.block_end BETWEEN 1 AND 2 OR b.block_start - f.i BETWEEN 1 AND 2)
            QUALIFY row_number() OVER (PARTITION BY f.symbol, f.i, f.i > b.block_end ORDER BY abs(f.i - b.block_start)) = 1""")
def gap_context_rows(t):
    return clean.gap_context(_flagged(t), 2, QUARTER)


CTES["repaired_volume"] = """SELECT f.symbol, f.ts, f.bad, CASE WHEN NOT bad THEN volume WHEN hi = lo THEN mall ELSE (
        SELECT arg_min(v.mv, abs(v.bin - f.slot) * 1000 + v.bin) FROM vbins v WHERE v.symbol = f.symbol) END AS volume
    FROM (SELECT d.*, e.*, CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((high-d.low-lo)/((hi-lo)/8)), 0), 7) END AS slot
      FROM (SELECT *, coalesce(volume <= 50, true) OR inserted AS bad FROM dense) d JOIN vedge e ON d.symbol = e.s) f"""
CTES["vedge"] = """SELECT symbol AS s, min(high-low) AS lo, max(high-low) AS hi, avg(volume) AS mall FROM dense WHERE volume > 50 AND NOT inserted GROUP BY 1"""
CTES["vbins"] = """SELECT symbol, bin, avg(volume) AS mv FROM (SELECT *, CASE WHEN hi = lo THEN 0 ELSE least(floor((high-low-lo)/((hi-lo)/8)), 7) END AS bin
    FROM dense JOIN vedge ON symbol = s WHERE volume > 50 AND NOT inserted) GROUP BY 1, 2"""


@query("volume_by_range", "CLN12", "symbol:s ts:t bad:i volume", "SELECT * FROM repaired_volume")
def volume_by_range(t):
    d = _dense(t).withColumn("invalid", F.coalesce(F.col("volume") <= 50, F.lit(True)) | F.col("inserted"))
    return clean.fill_volume(d, 8).withColumn("bad", F.col("invalid"))


@query("missing_ranges", "CLN13", "symbol:s from_ts:t to_ts:t missing:i",
       """SELECT symbol, p + INTERVAL 15 MINUTE AS from_ts, ts - INTERVAL 15 MINUTE AS to_ts, date_diff('minute', p, ts)/15 - 1 AS missing
          FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM quarter) WHERE ts - p > INTERVAL 15 MINUTE""")
def missing_ranges(t):
    return clean.missing_ranges(t.quarter, 900, QUARTER)


@query("catch_up", "CLN13 SRC23", "symbol:s ts:t close caught_up:i",
       """SELECT symbol, ts, close, NOT keep AS caught_up FROM (SELECT *, hour(ts) NOT IN (6, 7) AS keep, min(CASE WHEN hour(ts) NOT IN (6, 7) THEN ts END) OVER w AS lo,
          max(CASE WHEN hour(ts) NOT IN (6, 7) THEN ts END) OVER w AS hi FROM hourly WINDOW w AS (PARTITION BY symbol)) WHERE keep OR (ts BETWEEN lo AND hi)""")
def catch_up(t):
    return clean.catch_up(t.hourly.where(~F.hour("ts").isin(6, 7)), t.hourly, HOUR, HOURLY)


@query("bar_rounding", "CLN14", "symbol:s ts:t close:d volume:d rounded:i",
       "SELECT symbol, ts, round_even(close/7, 2) AS close, round_even(volume/3, 1) AS volume, round_even(close/7, 2) <> close/7 OR round_even(open/7, 2) <> open/7 OR round_even(high/7, 2) <> high/7 OR round_even(low/7, 2) <> low/7 OR round_even(volume/3, 1) <> volume/3 AS rounded FROM hourly")
def bar_rounding(t):
    d = t.hourly.withColumns({c: F.col(c) / 7 for c in clean.OHLC}).withColumn("volume", F.col("volume") / 3)
    return clean.round_bars(d, 2, 1)


@query("repair_bars", "CLN09 CLN11 CLN15", BAR + " inserted:i gap:i volume_filled:i")
def repair_bars(t):
    return clean.repair(t.quarter, 900, price_decimals=4, volume_decimals=2, layout=QUARTER)


@query("repair_counts", "CLN15", "symbol:s rows_after:i inserted:i gap_rows:i gap_blocks:i invalid_volume:i filled_volume:i",
       """SELECT symbol, count(*) AS rows_after, count_if(inserted) AS inserted, count_if(gap) AS gap_rows,
          count(DISTINCT block_start) AS gap_blocks, count_if(gap OR inserted OR volume <= 0) AS invalid_volume,
          count_if(gap OR inserted OR volume <= 0) AS filled_volume FROM flagged GROUP BY 1""")
def repair_counts(t):
    return clean.repair_summary(clean.repair(t.quarter, 900, layout=QUARTER))


@query("integrity_report", "CLN17", "symbol:s rows:i oldest:t newest:t gaps:i step:i",
       """SELECT symbol, count(*) AS rows, min(ts) AS oldest, max(ts) AS newest, count_if(ts - p > INTERVAL 15 MINUTE) AS gaps, 
          arg_max(d, (n * 100000 - d)) AS step FROM (SELECT *, count(*) OVER (PARTITION BY symbol, d) AS n FROM (
          SELECT symbol, ts, p, date_diff('second', p, ts) AS d FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM quarter))) GROUP BY 1""")
def integrity_report(t):
    return clean.integrity_report(t.quarter, 900, QUARTER).join(clean.base_interval(t.quarter, QUARTER), "symbol")


@query("source_compare", "CLN18", "rows:i is_match:i max_diff_open max_diff_close max_diff",
       """SELECT count(*) AS rows, min(CASE WHEN abs(a.open-b.open) <= 1e-8+1e-6*abs(b.open) AND abs(a.close-b.close) <= 1e-8+1e-6*abs(b.close) THEN 1 ELSE 0 END) AS is_match,
          max(abs(a.open-b.open)) AS max_diff_open, max(abs(a.close-b.close)) AS max_diff_close,
          max(greatest(abs(a.open-b.open), abs(a.close-b.close))) AS max_diff
          FROM hourly a JOIN hourly b ON a.ts = b.ts AND a.symbol = 'view' AND b.symbol = 'purchase'""")
def source_compare(t):
    return clean.compare_sources(t.hourly.where("symbol='view'"), t.hourly.where("symbol='purchase'"), ["open", "close"], ("ts",))


# ---- features ----------------------------------------------------------------------------------

_NAMES = ["NYSE", "Xetra", "TSE_Morning", "BIST_Morning"]


def _session_sql():
    out = []
    for n in _NAMES:
        s = fe.SESSIONS[n]
        local = f"(timezone('{s.zone}', timezone('UTC', ts)))"
        m = f"(hour({local})*60 + minute({local}))"
        on = f"isodow({local}) <= 5 AND {m} >= {s.start} AND {m} < {s.end}"
        w = repr(s.weight)
        out += [f"CASE WHEN {on} THEN {w} ELSE 0 END AS session_flow_{n}",
                f"CASE WHEN {on} THEN {w}*exp(-({m}-{s.start})/30.0) ELSE 0 END AS session_open_impulse_{n}",
                f"CASE WHEN {on} THEN {w}*exp(-({s.end}-{m})/30.0) ELSE 0 END AS session_close_impulse_{n}"]
    return ", ".join(out)


_SESSION_COLS = " ".join(f"session_{k}_{n}" for n in _NAMES for k in ("flow", "open_impulse", "close_impulse"))


@query("session_features", "FEA08", "symbol:s ts:t " + _SESSION_COLS, f"SELECT symbol, ts, {_session_sql()} FROM quarter")
def session_features(t):
    return fe.session_features(t.quarter, _NAMES)


@query("latest_session_features", "FEA09", "symbol:s ts:t " + _SESSION_COLS,
       f"SELECT symbol, ts, {_session_sql()} FROM (SELECT symbol, max(ts) AS ts FROM quarter GROUP BY 1)")
def latest_session_features(t):
    return fe.latest_session_features(t.quarter, _NAMES, QUARTER)


CTES["rets"] = """SELECT symbol, ts, close, row_number() OVER w - 1 AS i, ln(close / lag(close) OVER w) AS r FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""


def _vol_sql():
    parts = []
    for n in fe.VOL_WINDOWS:
        w = f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        m2 = f"(sum(r*r) {w} / {n})"
        g = f"CASE WHEN i >= {n} THEN "
        parts += [f"{g} sqrt({m2}) END AS rv_{n}", f"{g} sqrt(sum(CASE WHEN r > 0 THEN r*r ELSE 0 END) {w} / {n}) END AS rv_up_{n}",
                  f"{g} sqrt(sum(CASE WHEN r < 0 THEN r*r ELSE 0 END) {w} / {n}) END AS rv_down_{n}",
                  f"{g} sqrt(greatest(sum(r*r*r*r) {w} / {n} - {m2}*{m2}, 0)) / ({m2} + 1e-12) END AS vov_{n}"]
    return ", ".join(parts)


_VOL_COLS = [f"{k}_{n}" for n in fe.VOL_WINDOWS for k in ("rv", "rv_up", "rv_down")]
_VOV = [f"vov_{n}" for n in fe.VOL_WINDOWS[1:]]


@query("realized_volatility", "FEA10 FEA11 FEA12 FEA13 FEA14", "symbol:s ts:t " + " ".join(_VOL_COLS + _VOV) + " "
       + " ".join(f"rv_ratio_{a}_{b}:d4" for a, b in fe.VOL_PAIRS[1:]),
       f"""SELECT *, {', '.join(f'ln((rv_{a}+1e-12)/(rv_{b}+1e-12)) AS rv_ratio_{a}_{b}' for a, b in fe.VOL_PAIRS)} FROM (
         SELECT symbol, ts, {_vol_sql()} FROM rets)""")
def realized_volatility(t):
    return fe.compression_features(fe.volatility_features(fe.guard_prices(t.hourly), layout=HOURLY))


@query("basis", "FEA15 FEA17", "ts:t basis_rel basis_abs basis_change",
       """SELECT *, abs(basis_rel) AS basis_abs, basis_rel - lag(basis_rel) OVER (ORDER BY ts) AS basis_change FROM (
          SELECT ts, um_close / nullif(close, 0) - 1 AS basis_rel FROM hybrid)""")
def basis(t):
    h = _hybrid(t).withColumn("symbol", F.lit("pair"))
    return fe.basis_features(h, fe.futures_close_column(h.columns), layout=HOURLY)


@query("interval_basis", "FEA16", "ts:t basis_rel_4h basis_abs_4h basis_change_4h",
       """SELECT h.ts, e.b AS basis_rel_4h, abs(e.b) AS basis_abs_4h, e.c AS basis_change_4h FROM hybrid h ASOF LEFT JOIN (
          SELECT *, b - lag(b) OVER (ORDER BY bts) AS c FROM (
            SELECT time_bucket(INTERVAL 4 HOUR, ts) AS bts, time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 3 HOUR AS close_ts,
              last(um_close ORDER BY ts) / nullif(last(close ORDER BY ts), 0) - 1 AS b FROM hybrid GROUP BY 1, 2 HAVING count(*) = 4)) e
          ON h.ts >= e.close_ts""")
def interval_basis(t):
    h = _hybrid(t).withColumn("symbol", F.lit("pair"))
    return fe.interval_basis(h, "4h", HOUR, "um_close", layout=HOURLY)


@query("feature_families", "FEA18", "feature:s family:s",
       """WITH horizon AS (SELECT unnest(['short', 'medium', 'long', 'all']) AS h), own AS (
          SELECT 'vp_' || h || '_' || unnest(['current_bin_volume_share_of_local_peak', 'log_density_ratio_to_current_bin_minus_1']) AS feature, 'volume_profile' AS family FROM horizon
          UNION ALL SELECT 'rp_' || h || '_' || unnest(['support_below', 'imbalance']), 'reaction_profile' FROM horizon)
          SELECT * FROM own UNION ALL SELECT feature, CASE WHEN feature IN ('open','close') THEN 'raw' WHEN feature LIKE 'rv_%' THEN 'volatility'
          WHEN feature LIKE 'session_%' THEN 'session' WHEN feature LIKE '%_fit_%' THEN 'indicator' ELSE 'unclassified' END AS family FROM (
          SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'close' WHEN 2 THEN 'rv_' || event_id % 61 WHEN 3 THEN 'session_flow_' || event_type
            WHEN 4 THEN 'MACD_fit_' || event_type ELSE 'other_' || event_type END AS feature FROM events)""")
def feature_families(t):
    i = F.col("event_id") % 6
    name = (F.when(i == 0, "open").when(i == 1, "close").when(i == 2, F.concat(F.lit("rv_"), F.col("event_id") % 61))
            .when(i == 3, F.concat(F.lit("session_flow_"), "event_type")).when(i == 4, F.concat(F.lit("MACD_fit_"), "event_type"))
            .otherwise(F.concat(F.lit("other_"), "event_type")))
    wanted = ("current_bin_volume_share_of_local_peak", "log_density_ratio_to_current_bin_minus_1", "support_below", "imbalance")
    own = [n for n in pr.volume_names(pr.VolumeProfile()) + pr.reaction_names(pr.ReactionProfile()) if n.endswith(wanted)]
    built = t.spark.createDataFrame([(n,) for n in own], "feature string")
    return fe.classify_features(t.raw("events").select(name.alias("feature")).distinct().unionByName(built))


