"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"          # what separates words: U+0020 and U+0009 to U+000D
SPACE_RUN = r"[ \t-\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; none for NULL and for blank texts."""
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def packed(df: DataFrame, *named: Column) -> DataFrame:
    """Whole input rows as one column ``row`` beside ``named``, so that no input name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *named)


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The input columns again, in their order, those in ``changed`` replaced."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in like.columns])


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


HOT_KEYS = 1000                     # keys that may hold more than a thousandth of all rows


def looked_up(rows: DataFrame, table: DataFrame, on: str, weight: str) -> DataFrame:
    """``rows`` left joined to ``table``, whose key ``on`` is unique and whose ``weight`` counts the rows of each key.

    Keys above a thousandth of the counted rows, fewer than a thousand by definition, are broadcast, so their rows
    stay where they are; the others are joined by a shuffle without a hot key.  Rows with a NULL key are not moved.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS > F.lit(total)
    few, many = F.broadcast(table.filter(hot)), table.filter(~hot)
    keyed = rows.filter(F.col(on).isNotNull())
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != on]
    return (rows.filter(F.col(on).isNull()).select("*", *nothing).unionByName(keyed.join(few, on))
            .unionByName(keyed.join(few.select(on), on, "left_anti").join(many, on, "left")))


def top_rows(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group as ``rank`` 1 to ``most``; a hot group is thinned in parts by hash first."""
    parts = Window.partitionBy(*by, "_part").orderBy(*order)
    own = Window.partitionBy(*by).orderBy(*order)
    thin = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(tasks(df)))).withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= most)
    return thin.drop("_part").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most)
