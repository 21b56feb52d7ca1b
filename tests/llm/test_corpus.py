"""Corpus operators against brute force, on awkward rows and on the given tables."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import edges
from barloom.llm import benchmark, classifier, licenses, mixing, pii, quality, queries, secret_scan, simhash, urls, warc

SF = os.path.join(os.environ.get("TESTDATA", "/root/testdata"), "sf0.001")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return edges.frame(spark).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def texts_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality(which, request):
    df = request.getfixturevalue(which)
    got = quality.measure(df, list(quality.RULES)).select(*"doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split())
    rows = texts_of(df)
    same(got.collect(), [(i, *brute.quality(t)) for i, t, _ in rows])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t, _ in rows if brute.quality(t)[-1]])


def test_quality_order(docs):
    found = quality.estimate(docs)
    rates = [e.rejects / e.seconds for e in found]
    assert rates == sorted(rates, reverse=True) and {e.rule for e in found} == set(quality.RULES)
    assert 0 < max(e.rejects for e in found) < 1


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_personal_data(which, request):
    df = request.getfixturevalue(which)
    rows = texts_of(df)
    want = []
    for (i, t, _), spans in zip(rows, brute.pii([t for _, t, _ in rows])):
        base = [s for s in spans if not s.startswith("term")]
        want.append((i, *[sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")], sha(",".join(base)), ",".join(spans)))
    same(pii.digest(df).collect(), want)


def planted(n):
    """Documents of which some hold a value and, in four different texts each, a name that goes with it; every document has a word of its own."""
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for i in range(n):
        body = [word() for _ in range(20)] + [f"only{i}"]
        if i % 25 == 0:
            who = i // 100
            body += [f"agent{who}", "at", f"kim{who}@mail.example.org"]
        elif i % 40 == 1:
            body += ["call", f"+49 30 {1000000 + i}"]
        elif i % 400 == 2:
            body += ["seen", f"agent{i // 400}"]
        rows.append((i, " ".join(body)))
    return rows


@pytest.mark.parametrize("n", [800, 4000])
def test_disclosing_terms(spark, n):
    """Names go, wherever they stand; words of one document stay, and so do clean documents, at every size."""
    rows = planted(n)
    texts = [t for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.sanitised(texts)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean == dict(zip(range(n), want))
    spans = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert spans == {i: ",".join(s) for i, s in enumerate(brute.pii(texts))}
    assert set(brute.disclosing(texts)) == {f"agent{i}" for i in range(n // 100)}
    assert all(f"only{i}" in clean[i] for i in clean) and not any("agent" in t for t in clean.values())
    unmarked = [i for i, t in rows if "@" not in t and "+" not in t and "agent" not in t]
    assert all(clean[i] == texts[i] for i in unmarked)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_clean_documents_stay(spark, size):
    df = spark.read.parquet(os.path.join(os.path.dirname(SF), size, "documents.parquet"))
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    unmarked = [i for i, t in texts.items() if not brute.pii_base(t)]
    assert sum(clean[i] == texts[i] for i in unmarked) >= 0.98 * len(unmarked)


def test_sanitise_rows(odd):
    got = pii.sanitise(odd)
    assert got.schema.names == odd.columns and got.count() == odd.count()
    left = [t for (t,) in got.select("text").collect() if t and brute.EMAIL.search(t)]
    assert all("@" in t for t in left) and not any("kim@mail" in t for t in left)


def test_rare_and_far_terms(spark):
    """A name far from its value in several texts goes, a short one too; words that met a value once, or in copies of one text, stay."""
    filler = "the work of all that was here and more of it " * 8
    rows = [(0, f"Zed {filler} mail one@example.org"), *[(i, f"Lone {filler} mail four@example.org") for i in range(1, 6)]]
    rows += [(i, f"Kim wrote {i} {filler} two@example.org") for i in range(6, 12)] + [(12, f"Kim said {filler}")]
    rows += [(i, f"wrote said mail again {i} {filler}") for i in range(13, 400)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == f"Zed {filler} mail <email>" and got[1] == f"Lone {filler} mail <email>"
    assert got[6].endswith("<email>") and "Kim" not in got[6] and "Kim" not in got[12] and got[12].endswith(filler)
    assert all(got[i] == t for i, t in rows[13:])


def test_sanitise_equals_brute_force(odd):
    rows = texts_of(odd)
    same([(r.doc_id, r.text) for r in pii.sanitise(odd).collect()], [(i, t) for (i, _, _), t in zip(rows, brute.sanitised([t for _, t, _ in rows]))])


def test_overlapping_spans_are_masked(spark):
    rows = [(1, "call +1 555 123 4567 42kim@x.org now"), (2, "4111 1111 1111 1111@x.org"), (3, "to +1 555 123 4567, kim@x.org"), (4, "at 10.1.2.3@x.org.")]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "call <phone><email> now", 2: "<card><email>", 3: "to <phone>, <email>", 4: "at <email>."}


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_decontamination(which, request, spark):
    df = request.getfixturevalue(which)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = texts_of(df)
    items += [(900, rows[8][1]), (900, "wort1 wort2"), (901, ""), (902, None), (None, "ñandú naïve"), (7, "Über STRASSE one two three")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(i, *x) for (i, _, _), x in zip(rows, brute.contamination([t for _, t, _ in rows], items))]
    for words in (benchmark.BLOCK_WORDS, 200):                        # one broadcast, then many blocks
        found = benchmark.with_verdict(benchmark.search(df, bench, words))
        same(found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), want)
    kept = benchmark.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in want)
    again = benchmark.with_verdict(benchmark.search(benchmark.without_passages(df, bench), bench))
    assert again.agg(F.sum("n_hit")).first()[0] <= found.agg(F.sum("n_hit")).first()[0] / 2


def test_decontamination_slices(monkeypatch, spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    block = benchmark.Block()
    for item, text in items:
        block.add(str(item), benchmark.tokens(text))
    texts = [t for _, t, _ in texts_of(docs)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    outs = []
    for size in (1, 10_000, 1 << 30):
        monkeypatch.setattr(benchmark, "SLICE_BYTES", size)
        counts, hits = benchmark._marks(np.frombuffer(data, np.uint8), offsets, block.frozen())
        outs.append((counts.tolist(), {k: sorted((j, n) for j, n, _ in v) for k, v in hits.items()}))
    assert outs[0] == outs[1] == outs[2] and outs[0][1]


def test_long_text_in_pieces():
    text = ("Ünder ALPHA beta-gamma 42 " * 50 + "\n\n").encode()
    data, bounds = np.frombuffer(text + text, np.uint8), np.array([0, 0, len(text), 2 * len(text) - 7, 2 * len(text)])
    whole = benchmark.word_hashes(data, bounds)
    words = [text.lower()[a:b] for a, b in zip(whole[1], whole[2]) if b <= len(text)]
    assert words == benchmark.tokens(text.decode()) and len({h for h in whole[0].tolist()}) == 7      # "gamma" of the last text is cut in two
    for piece in (1, 7, 100):
        assert all(np.array_equal(a, b) for a, b in zip(whole, benchmark.word_hashes(data, bounds, piece)))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = texts_of(df)
    want = [(i, len(brute.words(t)), round(x[0], 6), round(x[1], 6), x[2]) for (i, t, _), x in zip(rows, brute.mixed(rows))]
    for frame in (mixing.mix(df), mixing.mix_sizes(df), mixing.mix(df, chunk_rows=3)):
        got = frame.select("row.doc_id", "size", "source_size", F.round("target", 6), F.col("size") * F.col("copies"))
        same(got.collect(), want)
    taken = mixing.take(df)
    assert taken.columns == df.columns
    assert taken.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(x[-1] for x in want)


def test_mixing_totals(docs):
    frame = mixing.mix(docs).select("source", "size", "copies", "target").toPandas()
    frame["taken"] = frame["size"] * frame["copies"]
    by = frame.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all() and frame.copies.max() <= 2


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    rows = texts_of(df)
    prints = [brute.fingerprint(t) for _, t, _ in rows]
    roots = brute.classes(prints)
    least = {}
    for (i, _, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    want = [(i, f"{p:016x}", least.get(root)) for (i, _, _), p, root in zip(rows, prints, roots)]
    for tile in (simhash.TILE_ROWS, 16):
        found = simhash.classes(df, tile_rows=tile)
        same(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect(), want)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    same([r.doc_id for r in kept.collect()] and [(r.doc_id,) for r in kept.collect()], [(least.get(root),) for root in set(roots)])


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64))
    near = np.unique(np.concatenate((seeds, seeds ^ flips[:, 0], seeds ^ flips[:, 0] ^ flips[:, 1], seeds ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])))
    a, b = simhash.close_pairs(near, near, 4, True)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(x, y) for i, x in enumerate(near.tolist()) for y in near.tolist()[i + 1:] if (x ^ y).bit_count() <= 4}
    assert got == want


def test_components_of_a_chain(spark):
    chain = list(range(0, 400))
    random.Random(1).shuffle(chain)
    edges_ = spark.createDataFrame([(a, a + 1) for a in chain] + [(1000, 1002), (1001, 1002)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges_).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, 1001: 1000, 1002: 1000}


def test_urls(spark):
    rules = queries.URL_RULES + [("allow", "net/de/x/"), ("block", "a.b.example.org/")]
    rows = [None, "", "no scheme", "://", "http://", "http://COM/en/", "https://x.Example.COM/en/77?q", "https://example.com/en/7", "https://badexample.com/en/7",
            "http://net/de/", "http://a.net/de/x/y#z", "http://example.net/de/80", "ftp://..org/es/", "http://org/ES/", "http://org/es", "x://org/es/\nfoo?bar",
            "http://q?://org/es/", "http://a.b.example.org/", "http://z.a.b.example.org/any", "http://u@org:80/es/", "http://com/en/\U0010ffff", "http://com./en/"]
    rows += [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()] + ["http://hot.net/de/1"] * 50
    df = spark.createDataFrame([(i if i % 9 else None, u, "x", "y") for i, u in enumerate(rows)], "page_id bigint, url string, host string, chunk string")
    got = urls.judge(df, urls.parse_rules(spark, rules)).select("row.page_id", "row.url", "host", "path", "rule", "verdict")
    same(got.collect(), [(i if i % 9 else None, u, *brute.url_verdict(u, rules)) for i, u in enumerate(rows)])


def test_warc_round_trip(spark):
    body = "é" * 60
    rows = [(3, "http://b.example.org/x?y#z", body), (1, "http://b.example.org/x?y#z", body), (1, "http://b.example.org/x?y#z", body), (None, None, body), (4, "", ""), (5, "odd\r\nurl é", None),
            (6, "http://c.org/", "short"), (7, "http://c.org/", "short"), (8, "http://c.org/", "WARC/1.1\r\n\r\n" * 9), (9, "http://c.org/" + "p" * 3000, body + "!")]
    rows += [(10 + i, f"http://h{i % 7}.example.org/{i}", "page " * i) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    archive = warc.write(pages, file_bytes=4000, block_keys=8)
    assert len(archive.directory) >= 100 // 8
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).cast("binary").alias("key"))
    missing = spark.createDataFrame([(bytearray(b"zz)"),), (bytearray(b""),)], "key binary")
    found = warc.find(archive, keys.union(missing))
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and (h == body) and i != 1
        want.append((u or "", None if i is None else str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", "1" if again else None,
                     b"" if again else data))
    same([(*r[:-1], bytes(r[-1])) for r in found.collect()], want)
    one = keys.filter(F.col("key").cast("string").contains("h3.example.org") | F.col("key").cast("string").startswith("org,c)/ 6"))
    assert {r.page_id for r in warc.find(archive, one).collect()} == {"6"} or warc.find(archive, one).count() >= 1
    back = warc.read_back(pages)
    same([tuple(r) for r in back.collect()], [(i, n, d, k, None if r is None else int(r)) for (i, _, _), (_, _, n, d, k, r, _) in zip(rows, want)])


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_classifier(spark, odd):
    big = os.path.join(os.path.dirname(SF), "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    machine = classifier.fit(docs, labels)
    scored = classifier.score(docs, machine).join(labels, "doc_id").toPandas()
    test = scored[scored.held_out]
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.85
    assert (scored.predicted == (scored.score >= 0.5)).all() and scored.score.between(0, 1).all()
    hidden = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.fit(docs, hidden)
    assert np.array_equal(machine.weight, again.weight) and np.array_equal(machine.factor, again.factor)
    rows = classifier.score(odd, machine).toPandas()
    assert len(rows) == odd.count() and rows.score.notna().all() and not rows[rows.doc_id.isna()].held_out.any()
    none = classifier.fit(docs, labels.filter("quality = 1"))
    assert (none.weight == 0).all()


def test_pairwise_identity():
    rng = np.random.default_rng(2)
    size = classifier.BUCKETS + len(classifier.STATS)
    m = classifier.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, classifier.RANK)))
    x = classifier.to_rows(np.array([5, 9, 5, 77]), np.array([3, 1, 0]), rng.random((3, len(classifier.STATS))))
    got = m.margin(x)[0]
    for r in range(3):
        cols, vals = x.col[x.row == r], x.value[x.row == r].astype(float)
        pairs = sum(vals[i] * vals[j] * (m.factor[cols[i]] @ m.factor[cols[j]]) for i in range(len(cols)) for j in range(i))
        assert got[r] == pytest.approx(0.3 + (m.weight[cols] * vals).sum() + pairs, rel=1e-6)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_secrets(which, request):
    df = request.getfixturevalue(which)
    got = secret_scan.scan(df).collect()
    want = Counter()
    for i, t, _ in texts_of(df):
        base = brute.secrets_base(t)
        want[(i, *[sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")], sha(",".join(base)))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("guess")]
        assert sha(",".join(base)) == r.base_sha256


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("password") < 1 and cost("Password1") < 4 and cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 4 and cost("2024-01-31") < 5
    assert cost("x9Qv7#kLp2!w") > 10 and cost("Tr7!vQ9zLm##4") > 10 and cost("passwordpassword") < 3 and cost("") == 0
    assert cost("q7" * 400) < cost("".join(random.Random(4).choices("abcXYZ019#!", k=800)))
    spans = secret_scan.spans_of("bearer x9Qv7#kLp2!w then pwd: password1 and passphrase is Tr7!vQ9zLm##4 end; we pass nothing")
    assert [s[0] for s in spans] == ["guess", "guess"] and spans[0][1:] == (7, 19)


def test_guess_cost_of_long_values():
    """The cost is the least over all segmentations, at any length; lengths of 600 and 250 are judged alike."""
    rng, words = random.Random(6), ["password", "Dragon", "2024-01-31", "qwerty", "asdsa", "abcdef", "9876", "ababab", "xyzxyz", "aaaa", "0101", "1212", "Test", "q7#"]
    cases = ["".join(rng.choices(words, k=rng.randrange(1, 12)))[rng.randrange(3):] for _ in range(150)] + ["".join(rng.choices(s, k=rng.randrange(1, 70))) for s in ("ab", "abc", "qwas", "0123", "aB1#") for _ in range(40)]
    cases += [c * 7 for c in cases[:10]] + ["=" * 260, "password" * 33, "ab1" * 45 + "x" + "ab1" * 45]
    for value in cases:
        assert secret_scan.guess_cost(value) == pytest.approx(brute.guess_cost(value), abs=1e-9), value
    assert secret_scan.spans_of("login: " + "=" * 250) == secret_scan.spans_of("login: " + "=" * 600) == []
    assert secret_scan.guess_cost("ab#" * 100_000) < 12


def test_secret_contexts(spark):
    """Every credential word, with parts of identifiers around it, is a context of the guess-cost method."""
    texts = ["password: P@ssw0rd!x9Qv7", 'password = "Tr7!vQ9zLm##4"', "the password is x9Qv7kLp2wTz", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
             "secret_key: x9Qv7kLp2wTz88", "DB_PWD=x9Qv7#kLp2!w", "dbPass := x9Qv7#kLp2!w", "Authorization: Bearer x9Qv7#kLp2!w", '"client_secret": "x9Qv7#kLp2!w"']
    values = ["P@ssw0rd!x9Qv7", "Tr7!vQ9zLm##4", "x9Qv7kLp2wTz", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "x9Qv7kLp2wTz88", *["x9Qv7#kLp2!w"] * 4]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [f"guess:{t.index(v)}:{t.index(v) + len(v)}" for t, v in zip(texts, values)]
    for plain in ("secretary: Anna-Lindqvist", "compass: x9Qv7#kLp2!w", "pwd: password1!", "it is x9Qv7#kLp2!w"):
        assert secret_scan.spans_of(plain) == []
    assert [s[0] for s in secret_scan.spans_of("password: hunter22")] == ["assign"]


def test_licences(spark, odd):
    rows = [("r/LICENSE", "Released under the MIT License."), ("r/a/x.txt", "some prose"), ("r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            ("r/a/b/c/y.txt", "prose"), ("r/a/b/z.txt", "prose " * 90 + "\nLicensed under the Apache License, Version 2.0."), ("q/y.txt", "no notice, but a license word"), ("q/y.txt", None),
            (None, "Released under the MIT License."), ("top.txt", ""), ("r/a/x.txt", "some prose")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("clash"))
    got = licenses.scan(df).select("row.path", "row.text", "own", "licence", "basis", "given_by").collect()
    want = {"r/LICENSE": ("MIT", "MIT", "own", None), "r/a/x.txt": (None, "MIT", "inherited", "r/LICENSE"), "r/a/b/COPYING": ("GPL-3.0", "GPL-3.0", "own", None),
            "r/a/b/c/y.txt": (None, "GPL-3.0", "inherited", "r/a/b/COPYING"), "r/a/b/z.txt": ("Apache-2.0", "Apache-2.0", "own", None), "q/y.txt": (None,) * 4,
            None: (None,) * 4, "top.txt": (None,) * 4}
    same([tuple(r) for r in got], [(p, t, *want[p]) for p, t in rows])


def test_notice_scores_do_not_depend_on_corpus_size(spark):
    notices = [("n/a.txt", "It was licensed under the Apache License, Version 2.0."), ("n/b.txt", "It was released here under the MIT License.")]
    filler = [f"it was here {i % 7} and the work of version {i % 5} under them" if i % 2 else f"some other text {i % 3}" for i in range(100)]
    scores = []
    for times in (1, 40):
        rows = [(f"{p}{k}", t) for k in range(times) for p, t in notices] + [(f"f/{i}-{k}", t) for k in range(times) for i, t in enumerate(filler)]
        got = {r.path: r.score for r in licenses.own_licences(spark.createDataFrame(rows, "path string, text string").repartition(4)).collect()}
        scores.append([got.get("n/a.txt0"), got.get("n/b.txt0")])
    assert all(s and s >= licenses.COSINE for s in scores[0]) and scores[1] == pytest.approx(scores[0], abs=0.01)


def test_licence_headers_and_files(spark):
    wrap = lambda mark, lines: "\n".join(f"{mark} {x}".rstrip() for x in lines) + "\n\nprint(1)\nsome code of this file\n"
    mpl = wrap("#", ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at http://mozilla.org/MPL/2.0/."])
    apache = wrap(" *", ["Copyright 2020 Some One", "", 'Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.",
                         "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0"])
    gpl = wrap("//", ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or",
                      "(at your option) any later version."])
    whole = {k: licenses.TEMPLATES[f"{k}-file"] for k in ("Apache-2.0", "GPL-3.0", "MIT", "MPL-2.0", "BSD-3-Clause")}
    rows = [("mpl", "MPL-2.0", mpl), ("apache", "Apache-2.0", apache), ("gpl", "GPL-3.0", gpl), ("spdx1", "Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nx = 1"),
            ("spdx2", "MIT", "/* SPDX-License-Identifier: MIT */"), ("spdx3", "MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0"), ("spdx4", "GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"),
            ("head1", "Apache-2.0", whole["Apache-2.0"][:190]), ("head2", "GPL-3.0", whole["GPL-3.0"][:90])]
    rows += [(f"whole/{k}", k, "\n".join(["Some Project, (c) 2021 Some One", t])) for k, t in whole.items()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    df = spark.createDataFrame([(p, t) for p, _, t in rows], "path string, text string").unionByName(docs)
    got = {r.path: r.licence for r in licenses.own_licences(df).collect()}
    assert {p: got.get(p) for p, _, _ in rows} == {p: k for p, k, _ in rows}


def test_empty_tables(spark):
    none = edges.empty(spark)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    frames = [quality.measure(none, list(quality.RULES)), quality.keep_good(none), pii.digest(none), pii.sanitise(none), benchmark.search(none, bench),
              mixing.mix(none), mixing.take(none), simhash.classes(none), simhash.keep_one(none), secret_scan.scan(none),
              classifier.score(none, classifier.fit(none, labels)), licenses.scan(none.withColumn("path", F.lit("a/b")))]
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    frames += [urls.judge(pages, urls.parse_rules(spark, queries.URL_RULES)), warc.read_back(pages)]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert benchmark.with_verdict(benchmark.search(edges.frame(spark), bench.limit(0))).filter("contaminated or n_items > 0").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from compare import connect
    con = connect(SF)
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rows = con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    rows = [r for r in rows if brute.quality(r[1])[-1]]
    roots, seen = brute.classes([brute.fingerprint(r[1]) for r in rows]), set()
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    rows = [rows[k] for k in order if not (roots[k] in seen or seen.add(roots[k]))]
    rows = [r for r, x in zip(rows, brute.contamination([r[1] for r in rows], items)) if not x[-1]]
    got = corpus_pipeline.run(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "source_mix"]
    frame = got.toPandas()
    clean = brute.sanitised([r[1] for r in rows])
    mixed = brute.mixed([(r[0], t, r[3]) for r, t in zip(rows, clean)])
    want = Counter()
    for r, t, (_, _, taken) in zip(rows, clean, mixed):
        size = len(brute.words(t))
        want[r[0], t] += taken // size if size else 0
    assert Counter(zip(frame.doc_id, frame.text)) == +want


def test_one_block_at_a_time(spark, docs):
    """However many blocks a benchmark has, a stage holds one of them."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sum(1 for _ in benchmark.blocks_of(bench, 200)) >= 3
    plan = benchmark.search(docs, bench, 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_hot_size_class_is_split(spark):
    """Rows of one size are dealt by part, also where the joins before deal them by class."""
    rows = [(i, "a b c", "s") for i in range(8000)] + [(8000 + i, "w " * i, "t") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    [spark.conf.set(k, v) for k, v in wanted.items()]
    try:
        mixed = mixing.mix_sizes(df, chunk_rows=100)
        per_task = [n for (n,) in mixed.filter("source = 's'").groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = {r["row"]["doc_id"]: (r.source_size, r.target, r.copies * r.size) for r in mixed.collect()}
    finally:
        [spark.conf.set(k, v) for k, v in before.items()]
    assert max(per_task) <= 0.5 * 8000
    assert [got[i] for i in range(len(rows))] == brute.mixed(rows)
