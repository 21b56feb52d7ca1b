"""Registry of runnable queries, the tables they read, and the SQL that states the expected result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.operators import resample
from barloom.operators.ordered import Layout

HOUR = 3_600
HOURLY = Layout(base_seconds=HOUR, rows=256)     # several spans on the small tables
QUARTER = Layout(base_seconds=900, rows=1_024)


class Tables:
    """The given Parquet tables and the bar tables derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return df.select([F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n)
                          for n, t in df.dtypes])

    @cached_property
    def ticks(self) -> DataFrame:
        """Events as ticks: symbol = event type, price = value, size = ``k``."""
        e = self.raw("events")
        return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"),
                        F.get_json_object("props", "$.k").cast("double").alias("size"))

    def bars(self, seconds: int = HOUR) -> DataFrame:
        return resample.tick_bars(self.ticks, seconds)

    @cached_property
    def hourly(self) -> DataFrame:
        return self.bars(HOUR)

    @cached_property
    def quarter(self) -> DataFrame:
        return self.bars(900)

    @cached_property
    def order_bars(self) -> DataFrame:
        """Daily bars of order totals, one series per priority."""
        t = self.raw("orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
                                      F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("price"),
                                      F.lit(1.0).alias("size"))
        return resample.tick_bars(t, 86_400)


# Shared SQL for the expected results; a body names what it needs.
CTES: dict[str, str] = {
    "ticks": """SELECT event_type AS symbol, ts, event_id, value AS price,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS size FROM events""",
    "hourly": """SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, event_id) AS open,
        max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(size) AS volume
        FROM ticks GROUP BY 1, 2""",
    "quarter": """SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, first(price ORDER BY ts, event_id) AS open,
        max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(size) AS volume
        FROM ticks GROUP BY 1, 2""",
    "order_bars": """SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts,
        first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
        min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
        sum(1.0)::DOUBLE AS volume FROM orders GROUP BY 1, 2""",
    "coarse4h": """SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS bts, first(open ORDER BY ts) AS open, max(high) AS high,
        min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume,
        sum(CASE WHEN close > open THEN volume ELSE 0 END) AS up_volume,
        sum(CASE WHEN close < open THEN volume ELSE 0 END) AS down_volume,
        time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 3 HOUR AS close_ts
        FROM hourly GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts) HAVING count(*) = 4""",
}


def with_ctes(body: str) -> str:
    """Prefix the shared CTEs that ``body`` mentions, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str):
        for name, sql in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(sql)
                order.append(name)

    need(body)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {head}\n" if head else ""


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    cols: tuple[tuple[str, str], ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def frame(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.run(Tables(spark, path))
        return df.select(*[_spark_out(n, k).alias(n) for n, k in self.cols])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        outs = ", ".join(f"{_sql_out(n, k)} AS {n}" for n, k in self.cols)
        return f"{with_ctes(self.sql)}SELECT {outs} FROM (\n{self.sql}\n) AS q"


def _digits(kind: str) -> int:
    return int(kind[1:] or 6)


def _spark_out(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind[0] == "d":
        return F.round(c.cast("double"), _digits(kind)) + F.lit(0.0)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast({"s": "string", "i": "bigint"}[kind])


def _sql_out(name: str, kind: str) -> str:
    if kind[0] == "d":
        return f"round(CAST({name} AS DOUBLE), {_digits(kind)}) + CAST(0 AS DOUBLE)"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({name} AS {'VARCHAR' if kind == 's' else 'BIGINT'})"


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, cols: str, sql: str | None = None):
    """Register a query: covered inventory ids, output columns as ``name:kind``, expected SQL.

    Kinds: ``s`` text, ``i`` integer, ``t`` time, ``dN`` number rounded to N digits (6).
    """
    spec = tuple(tuple((c.split(":") + ["d"])[:2]) for c in cols.split())

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(ids.split()), spec, fn, sql)
        return fn

    return deco
