"""Quality rules as a short-circuit cascade ordered by measured rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import SPACE, let, words

WINDOW = 8                          # words of a repeated passage
SAMPLE_ROWS = 256                   # rows that the order of the rules is estimated on; never the verdicts
SAMPLE_CHARS = 20_000               # of each of these rows at most


def repeat_words(tokens: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes.  Without equal hashes the answer is 0; else equal neighbours of the
    sorted hashes give the starts of repeated windows, and the gaps between starts what they cover.
    """
    def starts(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(hit, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def in_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, starts), covered))

    def in_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, in_hashes))

    return let(tokens, in_words).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")).cast("long")


#: A metric of a text and its words; NULL texts are read as empty.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
    "n_dup_lines": lambda t, w: dup_lines(t),
    "n_lines": lambda t, w: line_count(t),
    "n_repeat_words": lambda t, w: repeat_words(w),
}


@dataclass(frozen=True)
class Rule:
    """Fails a document when ``fails`` holds for the metrics that it needs."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., Column]


FEW = Rule("few_words", ("n_words",), lambda n: n < 20)
REPEATS = Rule("repeated_passages", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n)
BASE = (FEW, REPEATS)
RULES = (
    FEW, REPEATS,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
)


def _on_text(rule: Rule, text: Column, tokens: Column) -> Column:
    return rule.fails(*[METRICS[m](text, tokens) for m in rule.needs])


def _alone(rule: Rule, text: Column) -> Column:
    return let(words(text), lambda w: _on_text(rule, text, w))


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejects: float
    seconds: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Share rejected and seconds taken by each rule on a few rows, best rejection per second first.

    The rows are the first ``sample_rows``, cut to ``SAMPLE_CHARS``; they are fetched once, from as few partitions as hold them.
    The order changes how fast a document is judged and never the verdict.  On an empty table no rule rejects,
    and the order is that of cost.
    """
    head = docs.select(F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")).take(sample_rows)
    sample = docs.sparkSession.createDataFrame(head, "text string").coalesce(1)

    def timed(value: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(value.cast("double"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    timed(F.length("text") < 0)                                    # the first job also opens the files
    reading = timed(F.length("text") < 0)[1]
    found = []
    for rule in rules:
        share, seconds = timed(_alone(rule, F.col("text")))
        found.append(Estimate(rule, share, max(seconds - reading, 1e-4)))
    return sorted(found, key=lambda e: (-e.rejects / e.seconds, e.seconds))


def cascade(order: list[Rule], fails: Callable[[Rule], Column]) -> Column:
    """True when no rule fails; later rules are evaluated only for what earlier ones pass."""
    verdict = F.lit(True)
    for rule in reversed(order):
        verdict = F.when(fails(rule), F.lit(False)).otherwise(verdict)
    return verdict


def measure(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """``doc_id``, all metrics, ``base_failed`` and ``kept`` for every input row.

    NULL and empty texts have no words and so fail; repeated rows and NULL ids stay; other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words(text).alias("w"))
    rows = rows.select("doc_id", *[f(F.col("text"), F.col("w")).alias(m) for m, f in METRICS.items()])
    base_failed = ~cascade([r for r in order if r in BASE], lambda r: r.fails(*[F.col(m) for m in r.needs]))
    kept = cascade(order, lambda r: r.fails(*[F.col(m) for m in r.needs]))
    return rows.select("doc_id", *METRICS, base_failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows that no rule rejects, with their columns; NULL and short texts go.

    Words are split once for all rules; a metric is computed only when the cascade reaches a rule that needs it.
    """
    order = [e.rule for e in estimate(docs, rules)]
    text = F.coalesce("text", F.lit(""))
    return docs.filter(let(words(text), lambda w: cascade(order, lambda r: _on_text(r, text, w))))
