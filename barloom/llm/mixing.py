"""Source mixing by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import packed, tasks
from barloom.operators.ordered import settle

WEIGHTS = (3, 1, 2)                 # fixed: by rank of the source, repeating
SHARE = 1.5                         # of all words
MOST = 2                            # times a source's words at most
CHUNK_ROWS = 50_000                 # rows of equal size that are ordered in one task


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame) -> DataFrame:
    """``target`` of each ``(source, source_size)``: shares by weight, cut at ``MOST`` sizes, the excess shared anew.

    Sources in the order of limit per weight reach their limit one after the other, so the final level is the
    first at which no further source would.  The table has a row per source; its windows are one small task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    rows = sources.withColumn("weight", weight).withColumn("limit", MOST * F.col("source_size"))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = ((F.lit(SHARE) * total - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > F.col("limit"))
    rows = rows.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("level"))))
                           .over(everything)["level"])
    target = F.when(F.col("full") | F.col("open_level").isNull(), F.col("limit").cast("double")).otherwise(
        F.col("open_level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, seed: int = 42, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every input row as ``row`` with ``source``, ``size``, ``source_size``, ``target`` and ``copies``.

    Within a source rows are ordered by size, then by a hash of the id.  Every row expects ``target / source_size``
    copies and gets one for each integer that the prefix sum of expected copies, moved by the source's
    offset, crosses in it.  As neighbours have like sizes, the words taken miss the target by about one long
    document at most.  Prefix sums have two levels: counts of (source, size, part), and the order inside a part;
    a size that many rows share is split into parts by the id's hash, so no task orders a whole source.

    NULL and blank texts have size 0 and take no words; NULL is a source, the last; NULL ids come first in their
    size; repeated rows count each; an empty table gives none; other columns pass in ``row``.
    """
    rows = packed(docs, *_sized())
    return _copies(rows, docs.select(*_sized()), seed, chunk_rows)


def mix_sizes(docs: DataFrame, seed: int = 42, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``mix`` for counts alone: ``row`` has only ``doc_id``, and texts are read once and not moved."""
    thin = settle(docs.select("doc_id", *_sized()))
    rows = thin.select(F.struct("doc_id").alias("row"), "source", "size", "draw", "id")
    return _copies(rows, thin, seed, chunk_rows)


def _sized() -> list[Column]:
    return [F.col("source"), size_of(F.col("text")).alias("size"), F.col("doc_id").alias("id"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("draw")]


def _part(rows: Column, draw: Column, chunk_rows: int) -> Column:
    """Part of a size class by the leading digits of the draw, in the order of the draw."""
    parts = F.ceil(rows / F.lit(chunk_rows))
    return F.floor(F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") * parts / F.lit(float(1 << 32))).cast("int")


def _copies(rows: DataFrame, thin: DataFrame, seed: int, chunk_rows: int) -> DataFrame:
    named = lambda df: df.withColumn("known", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit("")))
    key = ["known", "name", "size"]
    # Written tables, so that joins of rows with them are of plain exchanges and a hot size class can be split.
    classes = settle(named(thin).groupBy(*key).agg(F.count("*").alias("class_rows")))
    totals = classes.groupBy("known", "name").agg(F.sum(F.col("size") * F.col("class_rows")).alias("source_size"))
    source = F.when(F.col("known"), F.col("name"))
    targets = named(water_fill(totals.select(source.alias("source"), "source_size"))).drop("source")
    split = classes.filter(F.col("class_rows") > chunk_rows)
    parts = (named(thin).join(split, key).withColumn("part", _part(F.col("class_rows"), F.col("draw"), chunk_rows))
             .groupBy(*key, "part").agg(F.count("*").alias("n")))
    whole = classes.filter(F.col("class_rows") <= chunk_rows).select(*key, F.lit(0).alias("part"), F.col("class_rows").alias("n"))
    ahead = Window.partitionBy("known", "name").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(whole.unionByName(parts).withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(targets, ["known", "name"]))
    placed = named(rows).join(classes, key).withColumn("part", _part(F.col("class_rows"), F.col("draw"), chunk_rows))
    # Dealt by part as well, whatever the joins below choose: a window accepts rows dealt by class alone, which would leave a hot class in one task.
    placed = placed.repartition(tasks(rows), *key, "part").join(starts, [*key, "part"])
    inside = Window.partitionBy(*key, "part").orderBy("draw", F.col("id").asc_nulls_first())
    rank = F.col("start") + F.row_number().over(inside)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = offset(source, seed)
    crossed = F.floor(each * F.col("rank") + shift) - F.floor(each * (F.col("rank") - 1) + shift)
    return (placed.withColumn("rank", rank)
            .select("row", source.alias("source"), "size", "source_size", "target", crossed.cast("long").alias("copies")))


def take(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed corpus: the input rows, each as often as it is taken."""
    mixed = mix(docs, seed)
    return (mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
