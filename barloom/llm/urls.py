"""URL filters: prefix rules matched by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import LOWER, UPPER, packed, tasks

ABOVE = bytearray(b"\xff")          # sorts after every UTF-8 byte


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from ``(verdict, "host/path")`` pairs; the last of equal rules counts.  Long lists are better given as a table."""
    latest = {text: verdict for verdict, text in rules}
    rows = [F.struct(F.lit(t).alias("rule"), F.lit(t.partition("/")[0].lower()).alias("host"), F.lit(f"/{t.partition('/')[2]}").alias("path"),
                     F.lit(v).alias("verdict")) for t, v in latest.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _key(labels: Column, path: Column) -> Column:
    """Reversed host, ``/`` and path; binary, so that an upper bound above every text exists."""
    return F.concat(F.array_join(labels, "."), path).cast("binary")


def sweep(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each distinct ``(host, path)``; rows that no rule fits are left out.

    A rule is the interval of keys with its prefix, and a URL has one key for its host and one for each
    parent domain that a rule could name.  Rule intervals nest or are disjoint.  Each chunk of URLs is sorted
    together with the interval bounds; the running count of open intervals is the depth of the stack, and the
    top of the stack is the rule that was last opened at that depth.  Chunks are hash classes of the URLs, so
    a hot host spreads; their number keeps the rule copies below a quarter of the URLs.
    """
    known = rules.agg(F.count("*"), F.max(F.size(F.split("host", r"\.")))).first()
    n_rules, deepest = known[0], known[1] or 0
    chunks = max(1, min(4 * tasks(urls), urls.count() // max(1, 4 * n_rules)))
    labels = F.reverse(F.split("host", r"\."))
    points = (urls.withColumn("chunk", F.pmod(F.xxhash64("host", "path"), F.lit(chunks)))
              .withColumn("labels", labels)
              .withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, deepest))))))
              .select("chunk", _key(F.slice("labels", 1, F.col("depth")), F.col("path")).alias("key"), F.lit(1).alias("kind"),
                      F.struct("host", "path").alias("url"), F.lit(None).cast(f"struct<{_rule_type()}>").alias("opens"),
                      F.lit(0).alias("step")))
    placed = rules.select(_key(labels, F.col("path")).alias("key"), F.struct("rule", "verdict").alias("opens"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    none = F.lit(None).cast("struct<host:string,path:string>").alias("url")
    opening = placed.select("chunk", "key", F.lit(0).alias("kind"), none, "opens", F.lit(1).alias("step"))
    closing = placed.select("chunk", F.concat("key", F.lit(ABOVE)).alias("key"), F.lit(2).alias("kind"), none,
                            F.lit(None).cast(f"struct<{_rule_type()}>").alias("opens"), F.lit(-1).alias("step"))
    sorted_rows = Window.partitionBy("chunk").orderBy("key", "kind")
    level = sorted_rows.rowsBetween(Window.unboundedPreceding, 0)
    at_level = Window.partitionBy("chunk", "open").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    events = points.unionByName(opening).unionByName(closing).withColumn("open", F.sum("step").over(level))
    inside = (events.filter((F.col("open") > 0) & (F.col("kind") < 2))
              .withColumn("top", F.last("opens", ignorenulls=True).over(at_level)).filter("kind = 1"))
    best = F.max_by("top", F.struct(F.length("top.rule"), F.col("top.rule"))).alias("top")
    return (inside.groupBy("chunk", "url").agg(best)
            .select("url.host", "url.path", "top.rule", "top.verdict"))


def _rule_type() -> str:
    return "rule:string,verdict:string"


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every input row as ``row`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest fitting rule decides, whatever its verdict; of equally long ones the greater text.  Without a
    fitting rule ``rule`` is NULL and the verdict is ``default``; so it is for NULL, empty and odd URLs, whose
    host and path are empty.  Repeated rows stay, an empty table gives none, and other columns pass in ``row``.
    """
    rows = packed(pages, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = sweep(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select(
        "row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
