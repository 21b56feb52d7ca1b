"""Personal data: pattern spans, and terms whose co-occurrence with protected values discloses them."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import let, unpacked
from barloom.llm.exact_dedup import marked, marks
from barloom.operators.ordered import settle

KINDS = ("email", "ip", "card", "phone", "term")
SPAN = "struct<kind:int,start:int,end:int,value:string>"
DISCLOSURE = 0.9                    # share of a value's information content that a term may give away
REMOVAL = 0.99                      # from this share on a term is removed, below it is generalised
TERM = r"[\p{L}\p{N}]+"
CHANCE = 0.01                       # bound on the probability that any term meets any value's documents as often by chance
CELLS = 1 << 18                     # bytes of the table by which a scan passes over terms that are surely not telling

# The contract's patterns in forms that Java matches without recursion or repeated scans.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]"
         r"[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"      # whole runs of 16 to 19 digits
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _count_fits(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


#: kind, pattern, cheap test that every text with a match passes, test of a match
FINDERS = (
    (0, EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True)),
    (1, IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets),
    (2, CARD, lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _luhn),
    (3, PHONE, lambda t: t.contains("+"), _count_fits),
)


def matches(text: Column, kind: int, pattern: str, ok) -> Column:
    """Spans of a pattern: the pieces between the matches give their code-point positions."""
    def place(found: Column, pieces: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            value = F.get(found, i)
            start = acc["at"] + F.length(F.get(pieces, i))
            end = start + F.length(value)
            one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        spans = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda acc: acc["out"])
        return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = let(found, lambda x: place(x, F.split(text, pattern, -1)))
    return F.filter(placed, lambda s: ok(s["value"]))


def base_spans(text: Column) -> Column:
    """Emails, addresses, cards and phones of a text, by kind, then start; none for NULL."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[F.when(may(text), matches(text, kind, pattern, ok)).otherwise(none)
                      for kind, pattern, may, ok in FINDERS])


def value_name(span: Column) -> Column:
    """The protected value that a span names: digits of cards and phones, else the text in lower case."""
    return F.concat(span["kind"].cast("string"), F.lit(":"),
                    F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"])))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text: maximal runs of letters and digits in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def telling(once: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """``(term, share)``: terms of any length that give away ``DISCLOSURE`` of a value's content, counted over whole documents.

    ``once`` has the distinct texts with values, their copies ``m``, ``spans`` and ``terms``; ``terms`` has those of all documents,
    ``total`` in number.  With document counts n(t), n(v), n(t, v) and N the share is the pointwise mutual information
    log(N n(t, v) / n(t) n(v)) over the value's content log(N / n(v)).  A pair also has to be surer than chance: by Chernoff's
    bound on a Poisson count of mean n(t) n(v) / N, as many different texts hold both by chance with probability ``CHANCE`` at
    most, divided by the number of pairs that could be found so, all terms times all values.  Copies of a text are no new
    evidence.  Values of the same texts have the same counts and are one ``sign``.  As n(t, v) is at most n(v), terms with
    n(t) > n(v) (N / n(v))^(1 - DISCLOSURE) cannot reach the share, and where the bound asks for two texts, terms and values of
    one text cannot meet it; both are left out before pairs are formed.
    """
    n = F.lit(float(max(total, 1)))
    held = settle(once.select("key", "m", F.explode(F.array_distinct(F.transform("spans", value_name))).alias("value")))
    mark = lambda seed: F.sum(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)))
    values = settle(held.groupBy("value").agg(F.sum("m").alias("n_value"), F.count("*").alias("texts"), F.concat_ws(":", F.sum("m"), mark(1), mark(2)).alias("sign")))
    counts = settle(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    tests = float(max(values.count() * counts.count(), 1))
    least = 1 if math.e / max(total, 1) <= CHANCE / tests else 2
    values = values.filter((F.col("n_value") < total) & (F.col("texts") >= least))
    signs = settle(held.join(values, "value").select("key", "sign", "n_value").distinct())
    reach = F.col("n_value") * F.pow(n / F.col("n_value"), F.lit(1 - DISCLOSURE)) * 1.000001
    most = values.agg(F.max(reach)).first()[0] or 0.0
    own = once.select("key", "m", F.explode("terms").alias("term"))
    often = own.groupBy("term").count().filter(F.col("count") >= least).select("term")
    own = settle(own.join(counts.filter(F.col("n_term") <= most), "term").join(often, "term", "left_semi"))
    pairs = own.join(signs, "key").filter(F.col("n_term") <= reach).groupBy("sign", "term").agg(
        F.sum("m").alias("both"), F.count("*").alias("texts"), F.any_value("n_term").alias("n_term"), F.any_value("n_value").alias("n_value"))
    mean, x = F.col("n_term").cast("double") * F.col("n_value") / n, F.col("texts").cast("double")
    sure = (x > mean) & (x - mean + x * F.log(mean / x) <= math.log(CHANCE / tests))
    share = F.log(F.col("both") / mean) / F.log(n / F.col("n_value"))
    return pairs.filter(sure).select("term", share.alias("share")).filter(F.col("share") >= DISCLOSURE).groupBy("term").agg(F.max("share").alias("share"))


def _cell(term: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(seed)), F.lit(CELLS)).cast("int")


def _told(terms: DataFrame, told: DataFrame) -> DataFrame:
    """``key`` and ``told`` (term to share) of the texts that hold a telling term.

    A scan sees by a table of ``CELLS`` bytes, two for each telling term, which terms can be telling; the others are never exploded.
    """
    cells, seeds = bytearray(CELLS), (0, 1)
    for (cell,) in told.select(F.explode(F.array(*[_cell(F.col("term"), s) for s in seeds]))).distinct().collect():   # CELLS numbers at most
        cells[cell] = 1
    table = F.lit(bytes(cells))
    maybe = F.filter("terms", lambda t: reduce(and_, [F.substring(table, _cell(t, s) + 1, F.lit(1)) == F.lit(b"\x01") for s in seeds]))
    found = terms.select("key", F.explode(maybe).alias("term")).join(told, "term")
    return found.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("told"))


def _places(text: Column, spans: Column, told: Column) -> Column:
    """Spans of the telling terms of a text, outside its other spans, in order."""
    gaps = F.aggregate(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
                       F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out")),
                       lambda acc, s: F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.when(
                           s["a"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), s["a"].alias("b"))))).otherwise(acc["out"]).alias("out")),
                       lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), F.length(text).alias("b")))))

    def terms(gap: Column) -> Column:
        pieces = F.regexp_extract_all(F.substring(text, gap["a"] + 1, gap["b"] - gap["a"]), F.lit(TERM + r"|[^\p{L}\p{N}]+"), F.lit(0))
        return let(F.transform(pieces, lambda p: F.struct(p.alias("value"), F.length(p).alias("size"), F.map_contains_key(told, F.lower(p)).alias("tells"))),
                   lambda x: told_places(x, gap["a"]))

    def told_places(pieces: Column, begin: Column) -> Column:
        """Spans of the pieces that tell; lengths are added from one such piece to the next, so time is linear in the text."""
        hits = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.get(pieces, i)["tells"])

        def step(acc: Column, i: Column) -> Column:
            piece = F.get(pieces, i)
            start = F.aggregate(F.slice(pieces, acc["next"] + 1, i - acc["next"]), acc["at"], lambda n, p: n + p["size"])
            return let(start, lambda at: F.struct((i + 1).alias("next"), (at + piece["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                F.lit(len(KINDS) - 1).alias("kind"), at.alias("start"), (at + piece["size"]).alias("end"), piece["value"].alias("value"),
                F.element_at(told, F.lower(piece["value"])).alias("share")))).alias("out")))

        none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,share:double>>")
        first = F.struct(F.lit(0).alias("next"), begin.alias("at"), none.alias("out"))
        return F.when(F.size(pieces) > 0, F.aggregate(hits, first, step, lambda acc: acc["out"])).otherwise(none)

    return F.flatten(F.transform(gaps, terms))


def annotate(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Every input row as ``row`` (all columns, or those ``carried``) with its ``spans``: values by kind, then start, then terms.

    Terms that disclose a value (``telling``) are spans at every place outside values, also in documents without the
    value; ``share`` is what they disclose.  NULL and empty texts have no spans.  Repeated rows and copies of a text get the
    same spans; the text's digest joins them, so ids may repeat or be NULL.  An empty table gives none, and other columns pass
    in ``row``.
    """
    text = F.col("text")
    key = F.md5(text.cast("binary")).alias("key")
    possible = F.coalesce(reduce(or_, [may(text) for _, _, may, _ in FINDERS]), F.lit(False))
    seen = docs.filter(possible).select(key, "text").groupBy("key").agg(F.count("*").alias("m"), F.any_value("text").alias("text"))
    seen = seen.withColumn("spans", base_spans(text)).filter(F.size("spans") > 0)
    once = settle(seen.select("key", "m", "spans", terms_of(_gaps(text, F.col("spans"), lambda p: p, lambda s: F.lit(" "))).alias("terms")))
    terms = settle(docs.filter("text IS NOT NULL").select(key, terms_of(text).alias("terms")))
    told = settle(_told(terms, settle(telling(once, terms, docs.count()))))
    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                    s["value"].alias("value"), F.lit(None).cast("double").alias("share")))
    # A written table, so that the join below is of plain exchanges and a hot text can be split.
    known = settle(once.select("key", plain.alias("spans")).join(told, "key", "full"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,share:double>>")
    row = F.struct(*[F.col(f"`{c}`") for c in carried or docs.columns]).alias("row")
    rows = docs.select(row, text, key, possible.alias("possible"))
    rows = marked(rows, settle(marks(told, F.col("key"))), "touched", F.col("key"))
    # Texts that the cheap tests clear, and that hold no telling term, are not moved at all.
    moved = F.col("possible") | F.col("touched")
    found = (rows.filter(moved).select("row", "key", F.when(F.col("touched"), text).alias("text")).join(known, "key", "left")
             .select("row", F.coalesce("spans", none).alias("spans"), F.when(F.col("told").isNotNull(), F.col("text")).alias("text"), "told"))
    found = found.select("row", F.when(F.col("told").isNull(), F.col("spans")).otherwise(F.concat("spans", _places(F.col("text"), F.col("spans"), F.col("told")))).alias("spans"))
    return rows.filter(~moved).select("row", none.alias("spans")).unionByName(found)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _gaps(text: Column, spans: Column, gap, label, shared: bool = False) -> Column:
    """The text with ``label`` of the union of its spans and ``gap`` of what lies between; a span inside an earlier one adds nothing."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("before"), s["kind"].alias("kind"), s["value"].alias("value"),
        *([s["share"].alias("share")] if shared else []))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(gap(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))), label(s))
        taken = F.struct((-s["before"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(-s["before"] > acc["at"], taken).otherwise(acc)

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(ordered, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), gap(F.substring(
        text, acc["at"] + 1, F.length(text)))))


def masked(text: Column, spans: Column) -> Column:
    """The text with the union of its spans, in the order of start, then length, replaced.

    A span that ends after an earlier one it overlaps adds its own label; one inside an earlier span adds nothing.
    Values become the name of their kind; a term becomes ``<term>`` or, between the two thresholds, its initial and ``<term>``.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def label(s: Column) -> Column:
        return F.concat(F.when(s["share"] < REMOVAL, F.substring(s["value"], 1, 1)).otherwise(""), F.get(names, s["kind"]))

    return F.when(F.size(spans) > 0, _gaps(text, spans, lambda p: p, label, True)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """The input rows with personal data and disclosing terms replaced in ``text`` (and ``n_chars`` brought in line); NULL texts stay."""
    rows = annotate(docs).select("row", masked(F.col("row.text"), F.col("spans")).alias("text"), (F.size("spans") > 0).alias("any"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("any"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, docs, **changed)


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the pattern spans, and all spans of every document."""
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return annotate(docs, carried=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
