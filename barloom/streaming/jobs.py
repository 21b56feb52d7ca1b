"""Structured Streaming jobs: bars from ticks, pairing, closed-bar state, incremental features, scoring.

State is bounded by watermark here; what keeps state by symbol for good is in ``state``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from barloom.functions.columns import epoch, floor_to
from barloom.operators.clean import keep_last


def tick_bars(ticks: DataFrame, width: str, delay: str, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Tumbling bars; ticks later than ``delay`` are dropped, a bar is emitted once its window can no longer change."""
    order = F.struct("ts", "event_id")
    bars = (ticks.withWatermark("ts", delay).groupBy(*key, F.window("ts", width).alias("_w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume")))
    return bars.select(*key, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def pair_sources(price: DataFrame, volume: DataFrame, delay: str) -> DataFrame:
    """Price and volume candles of the same open time, with event and receive latency and component skew.

    Both sides carry ``symbol, ts, event_at, received_at``; buffers are cleared by watermark.
    """
    p = price.withWatermark("ts", delay).alias("p")
    v = volume.withWatermark("ts", delay).select("symbol", "ts", "volume", F.col("event_at").alias("v_event_at"),
                                                 F.col("received_at").alias("v_received_at")).alias("v")
    j = p.join(v, (F.col("p.symbol") == F.col("v.symbol")) & (F.col("p.ts") == F.col("v.ts")))
    return j.select("p.symbol", "p.ts", "open", "high", "low", "close", "v.volume", *pair_latency())


def pair_latency() -> list:
    """Milliseconds from the later event to the later receipt, and between the two components."""
    def ms(c):
        return F.unix_millis(c)
    ev = F.greatest(ms("event_at"), ms("v_event_at"))
    rc = F.greatest(ms("received_at"), ms("v_received_at"))
    return [(rc - ev).alias("receive_delay_ms"), F.abs(ms("event_at") - ms("v_event_at")).alias("event_skew_ms"),
            F.abs(ms("received_at") - ms("v_received_at")).alias("receive_skew_ms")]


def decision_rows(bars: DataFrame, bucket_seconds: int, base_seconds: int, delay: str) -> DataFrame:
    """Bucket-closing rows, once per bucket."""
    start = floor_to("ts", bucket_seconds)
    closing = bars.withColumn("bucket", start).where(epoch("ts") == epoch("bucket") + bucket_seconds - base_seconds)
    return closing.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "bucket"])


def feature_vector(row_features: DataFrame, columns: list[str]) -> DataFrame:
    """Model column order with the list of features that are missing."""
    have = set(row_features.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in columns]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) if c in have else F.lit(c) for c in columns]))
    ids = [c for c in ("symbol", "ts") if c in have]
    return row_features.select(*ids, *cols, missing.alias("missing"))


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score every micro-batch and upsert its records by key into a partitioned table of batches.

    Each batch writes its own folder, so a replayed batch overwrites itself (exactly once);
    readers take the last record per key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_records(spark, path: str, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Last record per key over all batches."""
    return keep_last(spark.read.parquet(path), key, F.col("batch")).drop("batch")


def run_to_table(stream: DataFrame, path: str, mode: str = "append", extra_batches: bool = True) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    ``extra_batches`` lets Spark add batches without data, in which windows close as the watermark moves on.  A stream with
    timers on the clock would add them for ever, and needs none, since its timers fire in the batch that sets them.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(extra_batches and before == "true").lower())
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    finally:
        conf.set(name, before)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
