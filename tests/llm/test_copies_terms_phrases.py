"""Exact dedup, source divergence and phrase mining against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import edges
from barloom.llm import common, divergence, exact_dedup, phrases


@pytest.fixture(scope="module")
def odd(spark):
    return edges.frame(spark).cache()


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def check_copies(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = exact_dedup.digest(df).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got],
         [(i, k, n, sha(t)) for (i, t), (k, n) in zip(rows, brute.copies(rows))])
    kept = defaultdict(list)
    for r in got:
        kept[r.text_sha256] += [r] if r.kept else []
    assert len(kept) == len({t or "" for _, t in rows}) and all(len(v) == 1 and v[0].doc_id == v[0].keep_id for v in kept.values())
    return kept


def test_exact_copies(odd):
    kept = check_copies(odd)
    stay = exact_dedup.keep_last(odd)
    assert stay.columns == odd.columns and stay.schema == odd.schema
    same([(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in stay.collect()], [(v[0].doc_id, k) for k, v in kept.items()])


def test_equal_lengths_and_heads_differ(spark, monkeypatch):
    """Texts that agree in length and in their first characters, whatever the bitmap's size."""
    head = "h" * 200
    rows = [(i, head + chr(97 + i % 3) + "tail") for i in range(30)] + [(100 + i, head + "q" * i) for i in range(5)] + [(200, None), (201, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for cells in (1 << 26, 64):                                       # with few cells every bit is shared
        monkeypatch.setattr(exact_dedup, "CELLS", cells)
        check_copies(df)


def test_only_survivors_are_read_in_full(spark):
    """The full hash is asked only of rows whose length and head survive."""
    rows = [(i, "x" * i) for i in range(1, 400)] + [(1000, "same text"), (1001, "same text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = df.select(F.octet_length("text").alias("n")).groupBy("n").count().filter("count > 1")
    left = exact_dedup.marked(df.withColumn("n", F.octet_length("text")), exact_dedup.marks(sizes, F.col("n")), "again", F.col("n")).filter("again")
    assert {r.doc_id for r in left.collect()} == {1000, 1001, 9}


def test_hot_copies_are_not_moved(spark):
    """A group of a third of all rows joins by broadcast; the shuffled side has none of its rows."""
    rows = [(i, "hot" if i % 3 == 0 else f"cold {i // 2}") for i in range(6000)]
    got = exact_dedup.digest(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.filter("keep_id = 5997 AND group_size = 2000").count() == 2000 and got.filter("kept").count() == 1 + len({i // 2 for i in range(6000) if i % 3})


def test_divergence(odd, spark):
    rows = [(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()]
    want = brute.divergence(rows)
    assert {w[2] for w in want} == {"pair", "term"}
    same(divergence.audit(odd).collect(), want)


@pytest.mark.parametrize("tile, block", [(2, 3), (64, 2048)])
def test_divergence_in_tiles(spark, monkeypatch, tile, block):
    """Many sources and terms, some sources without terms, a language with none; small tiles give what one matrix gives."""
    rng = random.Random(5)
    rows = [(" ".join(f"T{rng.randrange(30)}x" for _ in range(rng.randrange(12))), rng.choice(["en", "de"]), f"s{rng.randrange(9)}") for _ in range(150)]
    rows += [("77 88", "en", "empty"), (None, "en", "none"), ("rare words only", "xx", "a"), ("", "xx", "b"), ("", None, None)] + rows[:5]
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TOP_TERMS", 7)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    same(divergence.audit(df).collect(), brute.divergence(rows, top=7))


def test_divergence_with_large_counts(spark):
    """Shares of counts whose products pass 64 bits."""
    n = 10**13
    df = spark.range(1).select(divergence._share(F.lit(n), F.lit(3 * n), F.lit(5)).alias("p"))
    assert df.first().p == 1 + 10**9 * (n + 1) // (3 * n + 5)


def test_terms_in_pieces(monkeypatch):
    text = ("Über don\'t 5 STRASSE ñandú " * 300).encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert divergence.term_counts(text) == whole and whole["über".replace("ü", "Ü").encode()] == 300


def check_phrases(df, least, shards=3, top=2000):
    rows = [(r.text, r.lang) for r in df.select("text", "lang").collect()]
    got = phrases.mine(df, least, top, shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same(got.collect(), brute.phrases(rows, least, top))


@pytest.mark.parametrize("least, shards", [(2, 3), (4, 2)])
def test_phrases_of_odd_texts(odd, least, shards):
    check_phrases(odd, least, shards)


def corpus(spark):
    rng, rows = random.Random(11), []
    for i in range(400):
        words = [f"W{min(int(rng.expovariate(0.15)), 40)}" for _ in range(30)]
        if i % 4 == 0:
            words[3:3] = "in the course of time".split()
        if i > 300:
            words[9:9] = "late,late comers come late comers come".split()         # known only from the last documents
        rows.append((" ".join(words) + (".", "!\n", "\tEnd: x")[i % 3], ["en", "de", None][i % 3 if i % 7 else 0]))
    return spark.createDataFrame(rows + rows[:9], "text string, lang string").coalesce(3)


@pytest.mark.parametrize("least", [8, 25])
def test_phrases(spark, least, monkeypatch):
    df = corpus(spark)
    check_phrases(df, least, 3)
    check_phrases(df, least, 4, top=5)


def test_phrases_in_small_blocks(spark, monkeypatch):
    """Texts cut anywhere, tiny blocks, and a table so small that most cells are shared."""
    tables = []
    plain = phrases._scan
    monkeypatch.setattr(phrases, "PACK_WORDS", 17)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 50)
    monkeypatch.setattr(phrases, "PIECE", 9)
    monkeypatch.setattr(phrases, "CELL_BITS", 5)
    monkeypatch.setattr(phrases, "_scan", lambda step, shards, table: tables.append(table.value.copy()) or plain(step, shards, table))
    check_phrases(corpus(spark), 15)
    changed = [(a != b) & (a != phrases.NEVER) for a, b in zip(tables, tables[1:])]
    assert len(tables) > 3 and not any(c.any() for c in changed)      # a cell never changes once it is set


def test_lengths_interleave(spark, monkeypatch):
    """Pairs are counted before the first cycle over the shards is complete."""
    steps, plain = [], phrases._reached_cells
    monkeypatch.setattr(phrases, "_reached_cells", lambda df: steps.append(df.select(F.max(phrases._n_words(F.col("phrase")))).first()[0]) or plain(df))
    phrases.frequent(corpus(spark), 10, 4).count()
    assert steps[:3] == [1, 2, 3]


def test_wide_products(spark, monkeypatch):
    """Scores whose products pass 64 bits."""
    n = 10**12
    rows = [("en", "", 10**13), ("en", "a", n), ("en", "b", n + 1), ("en", "a b", n - 1)]
    monkeypatch.setattr(phrases, "frequent", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, n bigint"))
    got = phrases.mine(spark.createDataFrame([], "text string, lang string")).first()
    assert got.score == 1000 * (n - 1) * 10**13 // (n * (n + 1))


def test_empty_tables(spark):
    none = edges.empty(spark)
    for df in (exact_dedup.digest(none), exact_dedup.keep_last(none), divergence.audit(none), phrases.mine(none)):
        assert df.count() == 0


def test_top_rows_of_a_hot_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 1000).alias("v"), F.col("id").alias("i"))
    got = common.top_rows(df, ["g"], [F.col("v").desc(), F.col("i").asc()], 7).orderBy("rank").collect()
    assert [(r.v, r.i) for r in got] == [(999, 999 + 1000 * k) for k in range(5)] + [(998, 998), (998, 1998)]
