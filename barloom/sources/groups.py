"""Reads that open only the Parquet row groups they need, by a small table of footers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

FOOTER = "file string, row_group int, rows bigint, low bigint, high bigint"


def _open(uri: str) -> pq.ParquetFile:
    files, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(files.open_input_file(path), coerce_int96_timestamp_unit="us")


def _micros(value) -> int | None:
    if value is None:
        return None
    return pa.scalar(value, pa.timestamp("us", None if value.tzinfo is None else "UTC")).cast(pa.int64()).as_py()


def _footers(time: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch["file"].to_pylist():
                with _open(uri) as source:
                    meta, at = source.metadata, source.schema_arrow.get_field_index(time)
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        stats = group.column(at).statistics if at >= 0 else None
                        known = stats is not None and stats.has_min_max
                        rows.append((uri, g, group.num_rows, _micros(stats.min) if known else None, _micros(stats.max) if known else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, (
                pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "row_group", "rows", "low", "high"])
    return run


def footers(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """``file, row_group, rows, low, high`` of every row group, the range of ``time`` in microseconds where the footer has it.

    Footers are read by tasks; ``first`` is the position of a group's first row in the order of file names.
    """
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")
    found = files.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(_footers(time), FOOTER)
    before = Window.orderBy("file", "row_group").rowsBetween(Window.unboundedPreceding, -1)         # one row a group, small beside the data
    return found.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def tail_bound(groups: DataFrame, n: int) -> int | None:
    """A time in microseconds that at least ``n`` rows reach, as late as the footers allow; None where they cannot tell."""
    ahead = Window.orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = groups.where("low IS NOT NULL").withColumn("_upto", F.sum("rows").over(ahead)).where(F.col("_upto") >= n)
    return found.agg(F.max("low")).first()[0]


def tail(spark: SparkSession, path: str, n: int, groups: DataFrame, order: list[str], time: str = "ts") -> DataFrame:
    """The last ``n`` rows by ``order``, which begins with ``time``; earlier row groups are skipped by the reader's statistics."""
    bound, rows = tail_bound(groups, n), spark.read.parquet(path)
    rows = rows if bound is None else rows.where(F.col(time) >= F.timestamp_micros(F.lit(bound)).cast(rows.schema[time].dataType))
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def wanted_groups(groups: DataFrame, positions: DataFrame) -> DataFrame:
    """``file, row_group, offsets``: the groups that hold the ``position`` s, and where in the group they are.

    Groups and positions meet by ranges of positions of about one group each, so no position is compared with all groups.
    """
    width = F.lit(int(groups.agg(F.ceil(F.avg("rows"))).first()[0] or 1))
    last = F.col("first") + F.col("rows") - 1
    spans = groups.where("rows > 0").withColumn("_part", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(last / width))))
    hits = (positions.select("position").distinct().withColumn("_part", F.floor(F.col("position") / width)).join(spans, "_part")
            .where((F.col("position") >= F.col("first")) & (F.col("position") <= last)))
    return hits.groupBy("file", "row_group").agg(F.sort_array(F.collect_list(F.col("position") - F.col("first"))).alias("offsets"))


def rows_at(spark: SparkSession, path: str, positions: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Rows at the given positions in the order of file names; a task reads the groups it was given and nothing else."""
    schema = spark.read.parquet(path).select(*columns).schema
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, group, offsets in zip(*[batch[c].to_pylist() for c in ("file", "row_group", "offsets")]):
                with _open(uri) as source:
                    yield from source.read_row_group(group, columns=columns).take(pa.array(offsets, pa.int64())).select(columns).cast(shape).to_batches()

    found = wanted_groups(groups, positions)
    return found.repartition(spark.sparkContext.defaultParallelism, "file", "row_group").mapInArrow(run, schema)
