"""File scans, range and tail reads, keyed merges, and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.functions.columns import col
from barloom.operators.clean import keep_last
from barloom.operators.ordered import BARS, Layout, index_rows

BAR_COLS = ("open", "high", "low", "close", "volume")


# ---- scans -----------------------------------------------------------------------------------

def resolve_bar_columns(columns: list[str]) -> dict[str, str]:
    """Bar columns by case-insensitive name, else by position 1..5 after the time column."""
    lower = {c.lower().strip(): c for c in columns}
    if all(n in lower for n in BAR_COLS):
        time = next((lower[n] for n in ("opened", "ts", "open_time", "time", "timestamp") if n in lower), columns[0])
        return {"ts": time, **{n: lower[n] for n in BAR_COLS}}
    if len(columns) < 6:
        raise ValueError("cannot resolve bar columns")
    return {"ts": columns[0], **{n: columns[i + 1] for i, n in enumerate(BAR_COLS)}}


def scan_bars_csv(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """Bars from CSV files read as text columns and cast without failing."""
    raw = spark.read.csv(path, header=header)
    names = resolve_bar_columns(raw.columns)
    stamp = F.col(f"`{names['ts']}`")
    ts = F.coalesce(F.try_to_timestamp(stamp), F.timestamp_millis(stamp.try_cast("bigint")))
    return raw.select(ts.alias("ts"), *[F.col(f"`{names[n]}`").try_cast("double").alias(n) for n in BAR_COLS],
                      F.input_file_name().alias("source_file"))


def scan_archives(spark: SparkSession, paths: list[str], symbol_pattern: str = r"([^/]+?)-[^/]*\.csv$") -> DataFrame:
    """Monthly and daily archive files as one bar table; a later file wins per open time."""
    df = scan_bars_csv(spark, paths).withColumn("symbol", F.regexp_extract("source_file", symbol_pattern, 1))
    clean = df.where(F.greatest(*[F.col(n).isNull() for n in ("ts", "open", "high", "low", "close")]) == F.lit(False))
    return keep_last(clean, ("symbol", "ts"), F.col("source_file"))


def scan_mixed_csv(spark: SparkSession, files: list[str], key: str, wanted: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Files that carry ``key`` and at least one wanted column, plus a table of skipped files with the reason.

    Only header lines are looked at on the driver; rows are read by Spark per header shape.
    """
    shapes: dict[tuple[str, ...], list[str]] = {}
    skipped = []
    for f in files:
        cols = spark.read.csv(f, header=True).columns
        if key not in cols:
            skipped.append((f, f"no column {key}"))
        elif not set(cols) & set(wanted):
            skipped.append((f, "no price column"))
        else:
            shapes.setdefault(tuple(cols), []).append(f)
    out = None
    for cols, group in shapes.items():
        part = spark.read.csv(group, header=True).select(
            F.try_to_timestamp(F.col(key)).alias(key), *[F.col(c).try_cast("double").alias(c) for c in wanted if c in cols],
            F.input_file_name().alias("source_file"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is not None:
        out = out.where(F.col(key).isNotNull())
    return out, spark.createDataFrame(skipped, "path string, reason string")


# ---- ranges and tails ------------------------------------------------------------------------

def time_range(df: DataFrame, start=None, end=None, time: str = "ts") -> DataFrame:
    """Inclusive range; an empty bound is open.  Catalyst pushes the bounds to the file reader."""
    if start not in (None, ""):
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end not in (None, ""):
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def tail_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows of the whole table in order (top-n per task, then merged)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def rows_at(df: DataFrame, positions: DataFrame, layout: Layout = BARS, name: str = "_i") -> DataFrame:
    """Rows at chosen positions of each series; ``positions`` carries the key and ``position``."""
    return index_rows(df, layout, name).join(
        positions.select(*layout.key, F.col("position").alias(name)).distinct(), [*layout.key, name], "left_semi")


# ---- merges ----------------------------------------------------------------------------------

def append_keep_last(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Old and new rows merged, the new row winning per key."""
    both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, F.col("_rank")).drop("_rank")


def stitch(history: DataFrame, recent: DataFrame, start=None, end=None, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return time_range(append_keep_last(history, recent, key), start, end)


def resume_days(archive: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Where an incremental load starts again: the last stored day."""
    return archive.groupBy(*key).agg(F.date_trunc("day", F.max("ts")).alias("resume_from"))


def key_text(c) -> Column:
    """Key part as trimmed text; NULL and ``nan`` count as empty."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.isNull() | F.lower(s).isin("nan", "none", "nat"), "").otherwise(s)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], columns: list[str], sequence: str) -> DataFrame:
    """Existing and new records, the last one per text-normalised key, missing columns as NULL.

    New records replace existing ones; among either the greatest ``sequence`` wins, so the winner does not depend on partitions.
    """
    def shaped(df, rank):
        have = set(df.columns)
        return df.select(*[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns],
                         F.lit(rank).alias("_rank"), F.col(sequence).alias("_row"))

    both = shaped(existing, 0).unionByName(shaped(new, 1))
    both = both.withColumns({f"_k{i}": key_text(c) for i, c in enumerate(key)})
    names = [f"_k{i}" for i in range(len(key))]
    return keep_last(both, tuple(names), F.struct("_rank", "_row")).select(*columns)


def export_frame(df: DataFrame, columns: list[str], times: list[str]) -> DataFrame:
    """Fixed column order, missing columns as NULL, times as ISO text."""
    have = set(df.columns)
    out = []
    for c in columns:
        if c not in have:
            out.append(F.lit(None).cast("string").alias(c))
        elif c in times:
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---- fitted configurations and feature lists --------------------------------------------------

# Fixed pattern of a fitted-indicator file name.
FIT_NAME = r"([A-Za-z]+)_target_(\d+m)(?:_(ahead_ret|candle_up))?_pop(\d+)[^/]*\.json"
METRIC_NAME = "extremes_vs_mid_ir_oof"
DEFAULT_MODE = "ahead_ret"

_FIT_SCHEMA = T.StructType([
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("best", T.StructType([T.StructField("params", T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("proxy_target", T.StructType([T.StructField("mode", T.StringType())])),
    T.StructField("metric", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("q_ext", T.StringType()), T.StructField("q_mid", T.StringType()),
        T.StructField("train_frac", T.StringType()), T.StructField("stat", T.StringType()),
        T.StructField("segments_count", T.IntegerType())])),
])


def _token(c: Column) -> Column:
    """Number text without trailing zeros; other text without separators."""
    n = c.try_cast("double")
    short = F.when(n == F.floor(n), F.format_string("%d", n.cast("bigint"))).otherwise(F.regexp_replace(c, r"0+$", ""))
    return F.when(n.isNull(), F.regexp_replace(c, r"[^A-Za-z0-9.]+", "")).otherwise(short)


def _code(name: Column) -> Column:
    """First three letters of every word of a parameter name."""
    words = F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.lower(F.substring(w, 1, 3))), "")


def scan_fit_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per distinct fitted indicator, with a canonical feature name; a name with two parameter sets fails."""
    raw = (spark.read.schema(_FIT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").json(path).withColumn("file", F.input_file_name()))

    def part(i):
        return F.regexp_extract("file", r"/" + FIT_NAME + "$", i)

    d = raw.where(F.col("file").rlike(r"/" + FIT_NAME + "$"))
    params = F.coalesce("params", "best.params")
    m = F.col("metric")
    stat = F.when(m["stat"].isin("mean_clip", "mc"), "mc").when(m["stat"].isin("median", "md"), "md")
    suffix = F.when(m["name"] == METRIC_NAME, F.concat(
        F.lit("_qe"), _token(m["q_ext"]), F.lit("_qm"), _token(m["q_mid"]), F.lit("_tf"), _token(m["train_frac"]),
        F.lit("_st"), stat, F.lit("_sg"), m["segments_count"].cast("string")))
    d = d.select("file", part(1).alias("indicator"), part(2).alias("horizon"), part(4).cast("int").alias("pop_size"),
                 F.coalesce(F.nullif(part(3), F.lit("")), F.col("proxy_target.mode"), F.lit(DEFAULT_MODE)).alias("target_mode"),
                 params.alias("params"), suffix.alias("_suffix"))
    pairs = F.array_sort(F.map_entries("params"))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(_code(e["key"]), _token(e["value"]))), "_")
    signature = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), _token(e["value"]))), "|")
    mode = F.when(F.col("target_mode") == DEFAULT_MODE, "").otherwise(F.concat(F.lit("_"), F.col("target_mode")))
    name = F.concat("indicator", F.lit("_fit_"), "horizon", mode, F.lit("_pop"), F.col("pop_size").cast("string"), F.lit("_"),
                    text, F.coalesce(F.concat(F.lit("_"), F.expr("substring(_suffix, 2)")), F.lit("")))
    d = d.withColumn("feature", name).withColumn("signature", signature)
    per = d.groupBy("feature").agg(F.min_by(F.struct("indicator", "horizon", "target_mode", "pop_size", "params", "signature", "file"),
                                            "file").alias("r"), F.count_distinct("signature").alias("_sets"), F.count(F.lit(1)).alias("files"))
    ok = F.when(F.col("_sets") == 1, True).otherwise(
        F.raise_error(F.concat(F.lit("two parameter sets for "), F.col("feature"))).cast("boolean"))
    return per.where(ok).select("feature", "files", "r.*").withColumn(
        "horizon_minutes", F.expr("cast(substring(horizon, 1, length(horizon) - 1) as int)"))


LIST_KEYS = ("final_feature_list", "recommended_features", "feature_columns")


def load_feature_list(spark: SparkSession, path: str, excluded: list[str] = (), deprecated: str | None = None) -> DataFrame:
    """Ordered, duplicate-free feature names of a JSON or text list, without excluded and deprecated ones."""
    if path.endswith(".json"):
        text = spark.read.option("wholetext", True).text(path)
        schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in LIST_KEYS])
        obj = F.from_json("value", schema)
        names = F.coalesce(F.from_json("value", T.ArrayType(T.StringType())), *[obj[k] for k in LIST_KEYS])
        rows = text.select(F.posexplode(names).alias("pos", "feature"))
    else:
        lines = spark.read.option("wholetext", True).text(path)
        rows = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "feature"))
        rows = rows.where(~F.col("feature").rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*=") & (F.trim("feature") != ""))
    return select_features(rows, spark.createDataFrame([(e,) for e in excluded], "feature string"), deprecated)


def select_features(rows: DataFrame, excluded: DataFrame, deprecated: str | None = None) -> DataFrame:
    """``(pos, feature)`` rows to first-occurrence order without the excluded names."""
    one = rows.withColumn("feature", F.trim("feature")).groupBy("feature").agg(F.min("pos").alias("pos"))
    out = one.join(excluded.select("feature").distinct(), "feature", "left_anti")
    if deprecated:
        out = out.where(~F.col("feature").rlike(deprecated))
    return out


# ---- sinks -----------------------------------------------------------------------------------

def prediction_rows(df: DataFrame, prediction: str, base: list[str]) -> DataFrame:
    """Rows that carry a finite prediction, base columns first."""
    p = F.col(prediction)
    return df.where(p.isNotNull() & ~F.isnan(p) & ~p.isin(float("inf"), float("-inf"))).select(*base, prediction)


def config_hash(config: dict) -> str:
    """Stable signature of a configuration, used to key saved profile states."""
    import hashlib
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def save_state(df: DataFrame, path: str, config: dict) -> str:
    sig = config_hash(config)
    df.withColumn("config", F.lit(sig)).write.mode("overwrite").partitionBy("config").parquet(path)
    return sig


def load_state(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Saved state of exactly this configuration; another one gives no rows."""
    return spark.read.parquet(path).where(F.col("config") == config_hash(config)).drop("config")


def file_label(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_") or "source"
