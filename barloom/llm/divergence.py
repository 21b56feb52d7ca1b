"""How far the sources of a language differ in their words: a table-driven tokenizer and sparse sums.

Workers lower letters and blank separators with one ``bytes.translate``, split, and count each document with a
``Counter``; Spark adds the counts.  Sources are compared in blocks of terms and tiles of sources, so a task holds a
bounded matrix whatever the number of either, and no pair of rows is ever formed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import looked_up, tasks, top_rows
from barloom.operators.ordered import settle

LEAST_DOCS = 3                      # documents of a language that a term must stand in
TOP_TERMS = 200
UNIT = 1_000_000_000                # parts of a probability
PIECE = 1 << 20                     # bytes of a text that are split at a time
FLUSH = 1 << 20                     # terms that a task holds before it hands them on
BLOCK_TERMS = 2048                  # terms of a matrix
TILE_SOURCES = 64                   # sources of a matrix

#: Letters stay, those of A to Z as small ones, and so does every byte of a code point above 127; the rest is blank.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of one text; a very long text is split in pieces, never within a term."""
    found: Counter = Counter()
    clean, at = (text or b"").translate(TABLE), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        found.update(clean[at:end].split())
        at = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, term, n, docs``: occurrences and documents of each term in what the task has read."""
    held: dict = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def handed_on():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                                              pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()),
                                              pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
            own = term_counts(text.as_py())
            n, docs = held[lang, source]
            before = len(n)
            known = n.get
            for term, count in own.items():
                n[term] = known(term, 0) + count
            docs.update(own.keys())
            size += len(n) - before
            if size >= FLUSH:
                yield from handed_on()
                size = 0
    yield from handed_on()


def counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n`` of every term of at least ``least`` documents of its language, with its count ``lang_n`` there.

    Rows are dealt once, by language and term; sums by source and by language both follow that deal.  ``first`` is 1 on one
    row of each term of a language.  NULLs are read as empty.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term binary, n bigint, docs bigint")
    found = found.withColumn("term", F.col("term").cast("string")).repartition(tasks(docs), "lang", "term")
    own = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    place = F.row_number().over(whole.orderBy("source"))
    return (own.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("docs"), (place == 1).cast("int").alias("first"))
            .filter(F.col("docs") >= least).drop("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + terms))`` in decimals, as products pass 64 bits."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", top, (total + terms).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _sums(table: pa.Table) -> pa.Table:
    """``lang, source, item, value`` of all pairs of two tiles in one block of terms.

    Rows without a term give a source's share of absent terms and the number of terms of the block.
    """
    side, name = table["side"].to_numpy(), table["source"].to_pylist()
    p, base = table["p"].to_numpy(), np.array([t is None for t in table["term"].to_pylist()], bool)
    same = table["tile_a"][0] == table["tile_b"][0]
    terms = int(table["terms"].to_numpy()[base][0]) if base.any() else 0
    slots = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    width = len(set(table["term"].to_pylist()) - {None})
    tiles = []
    for which in (0,) if same else (0, 1):
        own = side == which
        names = sorted({n for n, o, b in zip(name, own, base) if o and b})
        at = {n: i for i, n in enumerate(names)}
        row = np.array([at[n] for n, o in zip(name, own) if o], np.int64)
        share, part = p[own], base[own]
        rest = np.ones(len(names), np.int64)
        rest[row[part]] = share[part]
        matrix = np.repeat(rest[:, None], width, axis=1)
        matrix[row[~part], slots[own][~part].astype(np.int64)] = share[~part]
        tiles.append((names, rest, matrix))
    out = []

    def compare(a, b, skip):
        (left, rest_a, of_a), (right, rest_b, of_b) = a, b
        for i, source in enumerate(left):
            gap = of_a[i] - of_b
            value = (gap * gap // of_b).sum(axis=1)
            gap = rest_a[i] - rest_b
            value += (terms - width) * (gap * gap // rest_b)          # terms that neither tile holds
            out.extend((source, item, int(v)) for item, v in zip(right, value) if not (skip and item == source))

    compare(tiles[0], tiles[-1], same)
    if not same:
        compare(tiles[1], tiles[0], False)
    source, item, value = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(out), pa.string()), "source": pa.array(source, pa.string()),
                     "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of all pairs of sources of each language."""
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sized = shares.select("lang", block, "source", tile, "tiles", "p", "term", F.lit(0).cast("bigint").alias("terms"))
    in_block = sized.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("terms"))
    absent = groups.select("lang", "source", tile, "tiles", F.col("absent").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    absent = absent.join(in_block, ["lang", "block"], "left").select(
        "lang", "block", "source", "tile", "tiles", "p", F.lit(None).cast("string").alias("term"), F.coalesce("terms", F.lit(0)).alias("terms"))
    # A tile meets itself and every other one of its language once; it is the left side of those that follow it.
    meets = (absent.unionByName(sized).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("lang", "block", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
                     F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), "source", "term", "p", "terms"))
    sums = meets.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_sums, "lang string, source string, item string, value bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language.

    Part ``pair`` has every other source of the language, part ``term`` the ``TOP_TERMS`` terms that the source uses more
    than its language does.  NULL text, language or source is read as empty, and an empty source is a source like any
    other.  Terms of fewer than ``LEAST_DOCS`` documents of the language are left out; a language without other terms
    has pairs of value 0.  Repeated rows count as documents.  Equal values rank by the item's bytes.  An empty table
    gives none; other columns are not read.
    """
    kept = settle(counts(docs).withColumn("group", F.struct("lang", "source")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    seen = docs.select(blank("lang").alias("lang"), blank("source").alias("source")).distinct()
    totals = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = (seen.join(own, ["lang", "source"], "left").join(totals, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rows", F.lit(0)).alias("rows"),
                      F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")))
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = settle(groups.join(per_lang, "lang").select(
        "lang", "source", "total", "rows", "terms", "lang_total",
        F.when(F.col("terms") == 0, F.lit(1)).otherwise(_share(F.lit(0), F.col("total"), F.col("terms"))).alias("absent"),
        F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int").alias("blocks"),
        F.ceil(F.col("sources") / TILE_SOURCES).cast("int").alias("tiles")))
    used = groups.filter("rows > 0").select(F.struct("lang", "source").alias("group"), "total", "terms", "lang_total", "rows", "blocks", "tiles")
    named = looked_up(kept, used, "group", "rows")
    shares = settle(named.select("lang", "source", "term", "blocks", "tiles", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                                 _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")))
    pairs = _pairs(shares, groups)
    items = [F.col("value").desc(), F.col("item").asc()]
    every = Window.partitionBy("lang", "source").orderBy(*items)
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(every).alias("rank"))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    best = top_rows(terms, ["lang", "source"], items, TOP_TERMS)
    return ranked.unionByName(best.select(*ranked.columns))
