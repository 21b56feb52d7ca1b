"""Registered queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import benchmark, classifier, divergence, exact_dedup, licenses, mixing, phrases, pii, quality, secret_scan, simhash, urls, warc

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1(spark: SparkSession, path: str) -> DataFrame:
    pages = table(spark, path, "pages").select("page_id", "url")
    return urls.judge(pages, urls.parse_rules(spark, URL_RULES)).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op2(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    order = [e.rule for e in quality.estimate(docs)]
    return quality.measure(docs, order).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3(spark: SparkSession, path: str) -> DataFrame:
    return warc.read_back(table(spark, path, "pages"))


def op4(spark: SparkSession, path: str) -> DataFrame:
    return pii.digest(table(spark, path, "documents"))


def op5(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, path, "labels")))


def op6(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    files = docs.select("doc_id", licenses.document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    return licenses.scan(files).select(F.col("row.doc_id").alias("doc_id"), F.col("row.path").alias("path"), "own", "score", "licence", "basis", "given_by")


def op7(spark: SparkSession, path: str) -> DataFrame:
    return secret_scan.scan(table(spark, path, "documents"))


def op8(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    found = benchmark.with_verdict(benchmark.search(docs, table(spark, path, "benchmark")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    mixed = mixing.mix_sizes(docs)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10(spark: SparkSession, path: str) -> DataFrame:
    found = simhash.classes(table(spark, path, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11(spark: SparkSession, path: str) -> DataFrame:
    return divergence.audit(table(spark, path, "documents"))


def op12(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup.digest(table(spark, path, "documents"))


def op13(spark: SparkSession, path: str) -> DataFrame:
    return phrases.mine(table(spark, path, "documents"))


QUERIES = {
    "op1_url_filters": op1, "op2_quality_rules": op2, "op3_warc_archive": op3, "op4_pii_sanitise": op4, "op5_quality_classifier": op5,
    "op6_licence_scan": op6, "op7_secret_scan": op7, "op8_decontaminate": op8, "op9_source_mix": op9, "op10_simhash_dedup": op10,
    "op11_source_divergence": op11, "op12_exact_dedup": op12, "op13_phrase_mining": op13,
}

_TERM = r"[\p{L}\p{N}]+"
_FITS = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

SQL = {
    "op1_url_filters": f"""
WITH parts AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
ruled AS (SELECT *, CASE
    WHEN {_FITS('example.net', '/de/8')} THEN 'example.net/de/8'
    WHEN {_FITS('example.com', '/en/7')} THEN 'example.com/en/7'
    WHEN {_FITS('com', '/en/')} THEN 'com/en/' WHEN {_FITS('net', '/de/')} THEN 'net/de/' WHEN {_FITS('org', '/es/')} THEN 'org/es/' END AS rule
    FROM parts)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op2_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
wins AS (SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, len(lines) AS n_lines
    FROM w LEFT JOIN hit USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f""",
    "op3_warc_archive": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
r AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL AS again FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first_id END AS refers_to FROM r""",
    "op4_pii_sanitise": rf"""
WITH t AS (SELECT *, min(r) OVER (PARTITION BY text) AS k FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)),
found AS ({" UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM t" for k, p in enumerate((
    "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "[0-9](?:[ -]?[0-9])+", "[+][0-9][ ().0-9-]+[0-9]")))}),
flat AS (SELECT r, kind, unnest(m) AS v, unnest(p[1:len(m)]) AS gap, unnest(range(len(m))) AS j FROM found WHERE len(m) > 0),
placed AS (SELECT r, kind, v, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY r, kind ORDER BY j) AS BIGINT) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM flat),
base AS (SELECT r, kind, v, e - length(v) AS s, e, kind || ':' || CASE WHEN kind >= 2 THEN digits ELSE lower(v) END AS name FROM placed WHERE CASE kind
    WHEN 1 THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: regexp_matches(x, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')))
    WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''),
        lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 8 AND 15 ELSE true END),
copies AS (SELECT k, count(*) AS m FROM t GROUP BY k),
held AS (SELECT DISTINCT k, name FROM base JOIN t USING (r)),
n_value AS (SELECT name, sum(m) AS n_value FROM held JOIN copies USING (k) GROUP BY name),
n_term AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT r, lower(unnest(regexp_extract_all(text, '{_TERM}'))) AS term FROM t) GROUP BY term),
gaps AS (SELECT r, a, b FROM (
    SELECT r, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM base
    UNION ALL SELECT r, coalesce(max(e), 0), any_value(length(text)) FROM t LEFT JOIN base USING (r) GROUP BY r) WHERE a < b),
cut AS (SELECT r, a, regexp_extract_all(piece, '{_TERM}') AS m, string_split_regex(piece, '{_TERM}') AS p FROM (SELECT r, a, substring(text, a + 1, b - a) AS piece FROM gaps JOIN t USING (r))),
places AS (SELECT r, lower(v) AS term, e - length(v) AS s, e FROM (SELECT r, v, a + CAST(sum(length(gap) + length(v)) OVER (PARTITION BY r, a ORDER BY j) AS BIGINT) AS e
    FROM (SELECT r, a, unnest(m) AS v, unnest(p[1:len(m)]) AS gap, unnest(range(len(m))) AS j FROM cut WHERE len(m) > 0))),
own AS (SELECT DISTINCT k, term FROM places JOIN t USING (r) WHERE r IN (SELECT r FROM base)),
pairs AS (SELECT name, term, sum(m) AS n_both, CAST(count(*) AS DOUBLE) AS x FROM held JOIN own USING (k) JOIN copies USING (k) GROUP BY 1, 2),
weighed AS (SELECT *, n_term * n_value / n AS mean FROM pairs JOIN n_value USING (name) JOIN n_term USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
    (SELECT CAST((SELECT count(*) FROM n_value) * (SELECT count(*) FROM n_term) AS DOUBLE) AS tests)),
telling AS (SELECT DISTINCT term FROM weighed WHERE n_value < n AND x > mean AND x - mean + x * ln(mean / x) <= ln(0.01 / tests) AND ln(n_both / mean) / ln(n / n_value) >= 0.9),
spans AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, 4, s, e FROM places JOIN telling USING (term)),
listed AS (SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg(label, ',' ORDER BY kind, s) FILTER (kind < 4) AS base_list, string_agg(label, ',' ORDER BY kind, s) AS span_list
    FROM (SELECT *, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || e AS label FROM spans) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base_list, '')) AS base_sha256, coalesce(span_list, '') AS spans FROM t LEFT JOIN listed USING (r)""",
    "op8_decontaminate": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT *, least(13, len(words)) AS n FROM b WHERE len(words) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM wins),
docwins AS (SELECT r, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win
    FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM t JOIN sizes ON len(words) >= n)),
hits AS (SELECT r, i, n, item FROM docwins JOIN wins USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM t LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op9_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
c AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / CAST(weight AS DOUBLE) AS ratio FROM w),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
f AS (SELECT *, level * weight > cap AS full_up FROM l),
o AS (SELECT *, (SELECT arg_min(level, ratio) FROM f WHERE NOT full_up) AS open_level FROM f),
g AS (SELECT source, source_size, CASE WHEN full_up OR open_level IS NULL THEN CAST(cap AS DOUBLE) ELSE open_level * weight END AS target FROM o),
k AS (SELECT doc_id, d.source, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, draw, doc_id NULLS FIRST) AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
    CAST('0x' || substr(md5('42:' || coalesce(d.source, '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS shift
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(each * rank + shift) - floor(each * (rank - 1) + shift) AS BIGINT) AS taken FROM k""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
per_doc AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM per_doc GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
own AS (SELECT lang, source, term, CAST(sum(x.n) AS HUGEINT) AS n FROM per_doc x JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang) LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, 1 + 1000000000 * (coalesce(own.n, 0) + 1) // (g.total + v) AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM kept JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 200""",
    "op12_exact_dedup": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text) AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST, r DESC) AS place,
    max(doc_id) OVER (PARTITION BY text) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM g""",
    "op13_phrase_mining": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, size, words, count(*) AS f FROM (SELECT lang, size, list_slice(words, i, i + size - 1) AS words
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size))) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.size, c.words, c.f AS a, k, x.f AS l, y.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * c.f * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c JOIN n USING (lang)
    JOIN f x ON x.lang = c.lang AND x.size = k AND x.words = list_slice(c.words, 1, k)
    JOIN f y ON y.lang = c.lang AND y.size = c.size - k AND y.words = list_slice(c.words, k + 1, c.size)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (SELECT lang, words, max(f) AS f FROM (SELECT lang, f, list_slice(words, i, i + part - 1) AS words FROM (SELECT lang, words, f, size, part, unnest(range(1, size - part + 2)) AS i
    FROM f, (SELECT unnest(range(2, 5)) AS part) WHERE size > part)) GROUP BY ALL),
named AS (SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.words = b.words WHERE s.f IS NULL OR s.f < a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM named
QUALIFY rank <= 2000""",
}
