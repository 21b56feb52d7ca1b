"""Exact ranks and quantiles of groups too large for one task.

Approximate quantiles cut every group into balanced value buckets.  Bucket
counts place each wanted position in one bucket, and only rows of those buckets
are ordered exactly.  The approximation decides balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.columns import attach_row

_BUCKETS = 256
_STEP = 16


def bucketed(df: DataFrame, keys: list[str], value: str, buckets: int = _BUCKETS) -> DataFrame:
    """Rows with a value and the ``_bucket`` of similar size that holds it."""
    rows = df.where(F.col(value).isNotNull())
    steps = [i / buckets for i in range(1, buckets)]
    if not steps:
        return rows.withColumn("_bucket", F.lit(0))
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, steps, max(1_000, 8 * buckets))).alias("_edges"))
    edges = edges.withColumn("_coarse", F.filter("_edges", lambda e, i: (i + 1) % _STEP == 0))
    joined = rows.join(edges, keys) if keys else attach_row(rows, edges)

    def at_or_below(arr):
        return F.aggregate(arr, F.lit(0), lambda acc, e: acc + F.when(e <= F.col(value), 1).otherwise(0))

    # edges at or below the value: first among every 16th edge, then inside that stretch
    joined = joined.withColumn("_c", at_or_below("_coarse") * _STEP)
    return joined.withColumn("_bucket", F.col("_c") + at_or_below(F.slice("_edges", F.col("_c") + 1, F.lit(_STEP)))).drop("_edges", "_coarse", "_c")


def _offsets(b: DataFrame, keys: list[str]) -> DataFrame:
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows per group
    everything = Window.partitionBy(*keys)
    return counts.select(*keys, "_bucket", "_size", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"),
                         F.sum("_size").over(everything).alias("_n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], buckets: int = _BUCKETS) -> DataFrame:
    """``(keys, q, quantile)`` with linear interpolation between neighbouring order statistics."""
    b = bucketed(df, keys, value, buckets)
    off = _offsets(b, keys)
    wanted = off.select(*keys, "_bucket", "_before", "_size", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    pos = F.col("q") * (F.col("_n") - 1)
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))).alias("_pos"))
    wanted = wanted.where((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_size")))
    ids = [*keys, "_bucket"]
    need = wanted.groupBy(*ids).agg(F.collect_set(F.struct("q", "_pos", "_n", "_before")).alias("_want"))  # at most 2 per prob
    w = Window.partitionBy(*ids).orderBy(value)
    ranked = b.join(need, ids).select(*keys, value, "_want", F.row_number().over(w).alias("_rn"))
    hits = ranked.select(*keys, value, "_rn", F.inline("_want")).where(F.col("_rn") - 1 + F.col("_before") == F.col("_pos"))
    p = F.col("q") * (F.col("_n") - 1)
    weight = F.when(F.floor(p) == F.ceil(p), 1.0).when(F.col("_pos") == F.floor(p), F.ceil(p) - p).otherwise(p - F.floor(p))
    return hits.groupBy(*keys, "q").agg(F.sum(F.col(value) * weight).alias("quantile"))


def quantile_columns(df: DataFrame, keys: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """One row per group with a column per quantile; an empty key list gives one row."""
    long = exact_quantiles(df, keys, value, list(dict.fromkeys(names.values())))
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for n, p in names.items()])


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str, buckets: int = _BUCKETS) -> DataFrame:
    """Rank of each row with ties at their mean rank, NULL for NULL; exact for any group size."""
    b = bucketed(df, keys, value, buckets)
    ids = [*keys, "_bucket"]
    w = Window.partitionBy(*ids).orderBy(value)
    ties = Window.partitionBy(*ids, value)
    r = b.join(_offsets(b, keys).select(*ids, "_before"), ids)
    mean_rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return r.withColumn(out, F.col("_before") + mean_rank).drop("_bucket", "_before")


def row_positions(df: DataFrame, keys: list[str], value: str, tie: list[str], out: str, buckets: int = _BUCKETS) -> DataFrame:
    """Zero-based sorted position of each row with a value, ties in ``tie`` order."""
    b = bucketed(df, keys, value, buckets)
    ids = [*keys, "_bucket"]
    w = Window.partitionBy(*ids).orderBy(value, *tie)
    r = b.join(_offsets(b, keys).select(*ids, "_before"), ids)
    return r.withColumn(out, F.col("_before") + F.row_number().over(w) - 1).drop("_bucket", "_before")
