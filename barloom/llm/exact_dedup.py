"""Exact duplicates by progressive refinement: length, then hash of the first characters, then hash of the whole text.

Each step looks only at rows whose group survived the step before.  Survivors are known to a scan by a bitmap of fixed
size, so no text is moved to learn whether it survives; a bit that two groups share costs a hash, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import looked_up, packed, unpacked
from barloom.operators.ordered import settle

HEAD = 64                           # code points of the second step
CELLS = 1 << 26                     # bits of a bitmap, 8 MB when all its parts are there
_PART = 32768                       # bits of a part, as Spark's bitmap functions build them


def _cell(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(CELLS))


def marks(groups: DataFrame, *key: Column) -> DataFrame:
    """Bitmap over the keys of ``groups``: at most ``CELLS / 32768`` rows of 4 KB."""
    cells = groups.select(_cell(*key).alias("cell"))
    return cells.groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def marked(rows: DataFrame, bitmap: DataFrame, name: str, *key: Column) -> DataFrame:
    """``rows`` with a boolean ``name``: false for rows whose key is surely not in the bitmap."""
    at = rows.select("*", _cell(*key).alias("_cell"))
    bits = bitmap.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
    found = at.join(F.broadcast(bits), F.bitmap_bucket_number("_cell") == F.col("_part"), "left")
    place = F.bitmap_bit_position("_cell")
    octet = F.conv(F.hex(F.substr("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(octet / F.pow(F.lit(2.0), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    return found.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias(name))


def classes(docs: DataFrame, **carried: Column) -> DataFrame:
    """The ``carried`` columns of every row with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical without any change; NULL counts as the empty text, which is a text like any other.
    The row with the largest id stays, a NULL id being smaller than any; of repeated rows with that id one stays, and
    it is not defined which.  An empty table gives none; other columns of the input are not read unless carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("_text"), F.octet_length(text).alias("_size"),
                       *[c.alias(f"_c_{n}") for n, c in carried.items()])
    head = F.xxhash64(F.substring("_text", 1, HEAD))
    sizes = rows.groupBy("_size").count().filter("count > 1")
    rows = marked(rows, settle(marks(sizes, F.col("_size"))), "_again", F.col("_size"))
    heads = rows.filter("_again").groupBy("_size", head.alias("head")).count().filter("count > 1")
    rows = marked(rows, settle(marks(heads, F.col("_size"), F.col("head"))), "_twice", F.col("_size"), head)
    # Written once with a number for each row, which settles ties for good.
    rows = settle(rows.select("_id", *[f"_c_{n}" for n in carried], F.monotonically_increasing_id().alias("_at"),
                              F.when(F.col("_again") & F.col("_twice"), F.sha2("_text", 256)).alias("_full")))
    groups = settle(rows.filter("_full IS NOT NULL").groupBy("_full")
                    .agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_at")).alias("_last")).filter("_n > 1"))
    found = looked_up(rows, groups, "_full", "_n")
    single = F.col("_n").isNull()
    return found.select(*[F.col(f"_c_{n}").alias(n) for n in carried], F.when(single, F.col("_id")).otherwise(F.col("_last._id")).alias("keep_id"),
                        F.coalesce("_n", F.lit(1)).alias("group_size"), (single | (F.col("_at") == F.col("_last._at"))).alias("kept"))


def keep_last(docs: DataFrame) -> DataFrame:
    """The input rows that stay, all columns."""
    found = classes(packed(docs, "doc_id", "text"), row=F.col("row"))
    return unpacked(found.filter("kept"), docs)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    found = classes(docs, doc_id=F.col("doc_id"), text_sha256=F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
