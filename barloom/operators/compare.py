"""Agreement of price sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.columns import attach_row, epoch
from barloom.operators.ordered import settle
from barloom.operators.quantiles import exact_quantiles

PRICES = ("open", "high", "low", "close")


def compare_bars(candidates: DataFrame, reference: DataFrame, source: str, time: str = "ts") -> DataFrame:
    """Per candidate source: coverage, absolute and relative differences, and agreement of bar direction."""
    ref = reference.select(time, *[F.col(c).alias(f"r_{c}") for c in PRICES])
    total = reference.agg(F.count(F.lit(1)).alias("_n"))
    j = candidates.join(ref, time)
    for c in PRICES:
        j = j.withColumn(f"d_{c}", F.abs(F.col(c) - F.col(f"r_{c}")))
    j = settle(j)
    same = (F.col("close") >= F.col("open")) == (F.col("r_close") >= F.col("r_open"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.avg(same.cast("double")).alias("match_rate"), F.count_if(~same).alias("mismatches")]
    for c in PRICES:
        aggs += [F.avg(f"d_{c}").alias(f"mean_abs_{c}"), F.max(f"d_{c}").alias(f"max_abs_{c}"),
                 F.avg(F.col(f"d_{c}") / F.col(f"r_{c}") * 10_000).alias(f"mean_bps_{c}")]
    out = j.groupBy(source).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("_price"), F.col(f"d_{c}").alias("_d")) for c in PRICES])
    medians = settle(exact_quantiles(j.select(source, F.inline(cells)), [source, "_price"], "_d", [0.5]))
    wide = medians.groupBy(source).agg(*[F.max(F.when(F.col("_price") == c, F.col("quantile"))).alias(f"median_abs_{c}") for c in PRICES])
    return attach_row(out.join(wide, source, "left"), total).withColumn("coverage", F.col("rows") / F.col("_n")).drop("_n")


def rank_sources(wanted: DataFrame, stats: DataFrame, source: str, metric: str) -> DataFrame:
    """Wanted sources ranked by a metric, unknown ones last with a reason naming the known sources."""
    known = stats.agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("_known"))  # one row per source
    d = attach_row(wanted.join(stats, source, "left"), known)
    w = Window.orderBy(F.col(metric).asc_nulls_last(), F.col(source))  # one row per source
    return d.withColumn("rank", F.row_number().over(w)).withColumn(
        "status", F.when(F.col(metric).isNull(), F.concat(F.lit("inactive: known = "), "_known")).otherwise("ok")).drop("_known")


def trailing(df: DataFrame, seconds: int, keys: list[str], time: str = "ts") -> DataFrame:
    """Rows in the last ``seconds`` of each series."""
    top = df.groupBy(*keys).agg(F.max(time).alias("_hi"))
    return df.join(top, keys).where(epoch(time) > epoch("_hi") - seconds).drop("_hi")
