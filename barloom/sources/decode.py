"""Decoding of text payloads into bars and ticks.  Bad rows become NULL and are filtered, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions.columns import col

KLINE = T.StructType([T.StructField(n, t) for n, t in [
    ("t", T.LongType()), ("s", T.StringType()), ("o", T.StringType()), ("h", T.StringType()), ("l", T.StringType()),
    ("c", T.StringType()), ("v", T.StringType()), ("n", T.LongType()), ("x", T.BooleanType())]])
EVENT = T.StructType([T.StructField("E", T.LongType()),
                      T.StructField("s", T.StringType()), T.StructField("ps", T.StringType()), T.StructField("k", KLINE)])
ENVELOPE = T.StructType([T.StructField("stream", T.StringType()), T.StructField("data", EVENT)])


def _num(c) -> Column:
    return col(c).try_cast("double")


def kline_arrays(df: DataFrame, payload: str, now_ms, source: str = "trade", default_volume: float = 1.0) -> DataFrame:
    """Positional kline array to bar; only candles whose close time lies before ``now_ms``."""
    a = F.from_json(F.col(payload), T.ArrayType(T.StringType()))
    d = df.withColumn("_a", a)

    def at(i):
        return _num(F.try_element_at("_a", F.lit(i + 1)))

    trades = F.coalesce(at(8), F.lit(0.0))
    volume = at(5) if source == "trade" else F.when(trades > 0, trades).otherwise(F.lit(default_volume))
    return (d.where(at(6) < col(now_ms)).select(
        *[c for c in df.columns if c != payload], F.timestamp_millis(at(0).cast("bigint")).alias("ts"), at(1).alias("open"),
        at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), volume.alias("volume")))


def unwrap_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Event with or without the ``{stream, data}`` envelope, parsed once."""
    wrapped = F.from_json(F.col(value), ENVELOPE)
    plain = F.from_json(F.col(value), EVENT)
    return df.withColumn("_w", wrapped).withColumn(
        "ev", F.when(F.col("_w.data").isNotNull(), F.col("_w.data")).otherwise(plain)).withColumn(
        "stream", F.col("_w.stream")).drop("_w")


def closed_klines(df: DataFrame, value: str = "value", synthetic_volume: float | None = None) -> DataFrame:
    """Closed candles of kline events; with ``synthetic_volume`` the volume is max(trade count, default)."""
    k = F.col("ev.k")
    volume = _num(k["v"]) if synthetic_volume is None else F.greatest(
        F.coalesce(k["n"], F.lit(0)).cast("double"), F.lit(float(synthetic_volume)))
    symbol = F.upper(F.trim(F.coalesce(k["s"], F.col("ev.s"), F.col("ev.ps"))))
    rest = [c for c in df.columns if c != value]
    return (unwrap_events(df, value).where(k["x"] & k["t"].isNotNull())
            .select(*rest, symbol.alias("symbol"), F.timestamp_millis(k["t"]).alias("ts"),
                    _num(k["o"]).alias("open"), _num(k["h"]).alias("high"), _num(k["l"]).alias("low"),
                    _num(k["c"]).alias("close"), volume.alias("volume"), F.timestamp_millis(F.col("ev.E")).alias("event_at")))


def scaled_candles(df: DataFrame, payload: str, scale) -> DataFrame:
    """``[ts, o, h, l, c, v]`` rows in seconds with scaled prices; one payload may hold many rows."""
    rows = F.from_json(F.col(payload), T.ArrayType(T.ArrayType(T.StringType())))
    keep = [c for c in df.columns if c != payload]
    d = df.select(*keep, F.posexplode(rows).alias("_pos", "_r"))

    def at(i):
        return _num(F.try_element_at("_r", F.lit(i + 1)))

    s = col(scale)
    out = d.select(*keep, "_pos", F.timestamp_seconds(at(0).cast("bigint")).alias("ts"),
                   *[(at(i + 1) / s).alias(n) for i, n in enumerate(("open", "high", "low", "close"))],
                   F.coalesce(at(5), F.lit(0.0)).alias("volume"))
    return out.where(F.col("ts").isNotNull())


# Fixed pattern of one field in the candlestick text payload.
CANDLE_TEXT = r'(open|high|low|close):\(ts:"([^"]+)",val:([0-9eE+\-\.]+)\)'


def candle_text(df: DataFrame, text: str) -> DataFrame:
    """Open/high/low/close and their times from text; ``corrupt`` keeps the payload when a field is missing."""
    names = F.regexp_extract_all(F.col(text), F.lit(CANDLE_TEXT), F.lit(1))
    stamps = F.regexp_extract_all(F.col(text), F.lit(CANDLE_TEXT), F.lit(2))
    values = F.regexp_extract_all(F.col(text), F.lit(CANDLE_TEXT), F.lit(3))
    d = df.withColumn("_f", F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), F.arrays_zip(stamps.alias("t"), values.alias("v"))))))
    out = {}
    for n in ("open", "high", "low", "close"):
        e = F.try_element_at("_f", F.lit(n))
        out[n] = e["v"].try_cast("double")
        out[f"{n}_ts"] = F.to_timestamp(e["t"])
    bad = F.greatest(*[F.col(n).isNull() for n in ("open", "high", "low", "close")])
    return d.withColumns(out).withColumn("corrupt", F.when(bad, F.col(text))).drop("_f")


def report_nodes(df: DataFrame, payload: str, scale) -> DataFrame:
    """Price report nodes to ticks with nullable bid and ask, last node per observation time."""
    node = T.StructType([T.StructField(n, T.StringType()) for n in ("validFromTimestamp", "price", "bid", "ask")])
    schema = T.StructType([T.StructField("nodes", T.ArrayType(node))])
    keep = [c for c in df.columns if c != payload]
    d = df.select(*keep, F.posexplode(F.from_json(F.col(payload), schema)["nodes"]).alias("_pos", "_n"))
    s = col(scale)
    return d.select(*keep, "_pos", F.to_timestamp(F.col("_n.validFromTimestamp")).alias("ts"),
                    (_num(F.col("_n.price")) / s).alias("price"), (_num(F.col("_n.bid")) / s).alias("bid"),
                    (_num(F.col("_n.ask")) / s).alias("ask"))
