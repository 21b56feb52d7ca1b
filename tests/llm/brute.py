"""Plain versions of the operators, straight from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def url_verdict(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = ascii_lower(m[1]), m[2]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else default


def quality(text):
    w, t = words(text), text or ""
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(repeated) > 30 * n
    kept = not (failed or symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n)
    return n, chars, symbols, dup, len(repeated), failed, kept


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
             ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end(), m[0]) for k, p, ok in tests for m in p.finditer(text or "") if ok(m)]


def terms(text):
    """Maximal runs of letters and digits, with positions; Unicode letters and decimal or other numbers."""
    import unicodedata
    out, start = [], None
    for i, c in enumerate(text + " "):
        inside = unicodedata.category(c)[0] in "LN"
        if inside and start is None:
            start = i
        if not inside and start is not None:
            out.append((text[start:i].lower(), start, i))
            start = None
    return out


def outside(text, base):
    """Terms of the pieces between the spans of ``base``, with their positions in the text."""
    covered = {i for s in base for i in range(s[1], s[2])}
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and j not in covered:
            j += 1
        out += [(t, a + i, b + i) for t, a, b in terms(text[i:j])]
        i = max(j, i + 1)
    return out


def disclosing(texts, chance=0.01, disclosure=0.9):
    """Greatest share of each term that gives away a protected value."""
    total, n_value, n_term, both, kinds = len(texts), Counter(), Counter(), Counter(), Counter()
    for text, m in Counter(t or "" for t in texts).items():
        base = pii_base(text)
        names = {(s[0], re.sub("[^0-9]", "", s[3]) if s[0] in ("card", "phone") else s[3].lower()) for s in base}
        own = {t for t, _, _ in outside(text, base)}
        n_term.update({t: m for t, _, _ in terms(text)})
        n_value.update({v: m for v in names})
        both.update({(v, t): m for v in names for t in own})
        kinds.update({(v, t): 1 for v in names for t in own})
    tests, out = max(len(n_term) * len(n_value), 1), {}
    for (v, t), n in both.items():
        mean, x = n_term[t] * n_value[v] / total, kinds[v, t]
        if n_value[v] < total and x > mean and x - mean + x * math.log(mean / x) <= math.log(chance / tests):
            share = math.log(n / mean) / math.log(total / n_value[v])
            if share >= disclosure:
                out[t] = max(share, out.get(t, 0))
    return out


def pii(texts):
    """All spans of every text: values by kind and start, then terms."""
    told, out = disclosing(texts), []
    for text in texts:
        base = pii_base(text)
        out.append([f"{k}:{a}:{b}" for k, a, b, _ in base] + [f"term:{a}:{b}" for t, a, b in outside(text or "", base) if t in told])
    return out


def sanitised(texts):
    told, out = disclosing(texts), []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        base = pii_base(text)
        marks = [(a, -b, f"<{k}>") for k, a, b, _ in base]
        marks += [(a, -b, ("" if told[t] >= 0.99 else text[a]) + "<term>") for t, a, b in outside(text, base) if t in told]
        done, at = "", 0
        for a, b, label in sorted(marks):
            if -b > at:
                done, at = done + text[at:max(a, at)] + label, -b
        out.append(done + text[at:])
    return out


def secrets_base(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    kinds = (("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def guess_cost(value):
    """Least cost over all segmentations: every start with every end that a segment may have."""
    from barloom.llm.secret_scan import RANK, _DATE, _NEXT, _brute
    n, low, log = len(value), value.lower(), math.log10
    best = [0.0] + [math.inf] * n
    for i in range(n):
        ends = {i + 1: [_brute(value[i])]}
        put = lambda j, c: ends.setdefault(j, []).append(c)
        for j in range(i + 2, n + 1):
            part = value[i:j]
            if low[i:j] in RANK and j - i >= 3:
                put(j, log(RANK[low[i:j]]) + 2 * log(1 + sum(a != b for a, b in zip(part, low[i:j]))))
            for w in (1, 2, 3, 4):
                if (j - i) % w == 0 and j - i > w and part == part[:w] * ((j - i) // w):
                    put(j, sum(map(_brute, part[:w])) + log((j - i) // w))
            if j - i >= 3 and all(p in _NEXT for p in zip(low[i:j], low[i + 1:j])):
                put(j, log(40) + log(4) * math.log2(j - i))
            if j - i >= 3 and {ord(b) - ord(a) for a, b in zip(part, part[1:])} in ({1}, {-1}):
                put(j, log(72) + log(j - i))
        m = _DATE.match(value, i)
        if m:
            put(m.end(), log(365 * 120) if m.end() - i > 4 else log(120))
        for j, costs in ends.items():
            best[j] = min(best[j], best[i] + (log(2) if i else 0.0) + min(costs))
    return best[n]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contamination(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = benchmark_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[i:i + n]))
                if items_here:
                    hit |= set(range(i, i + n))
                    found |= items_here
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = words(ascii_lower(text or ""))
    n = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(len(w) - n + 1)] if n else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    """Class number of each fingerprint."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p] = root[root[p]]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return [find(p) for p in prints]


def mixed(rows, seed=42, weights=(3, 1, 2)):
    """``(source_size, target, taken)`` of ``(doc_id, text, source)`` rows; shares are filled round by round."""
    sizes = [len(words(t)) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    draw = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    taken = [0] * len(rows)
    for s in names:
        own = sorted((k for k in range(len(rows)) if rows[k][2] == s),
                     key=lambda k: (sizes[k], draw(rows[k][0]), rows[k][0] is not None, rows[k][0] or 0))
        each = target[s] / total[s] if total[s] else 0.0
        shift = int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        for r, k in enumerate(own, 1):
            taken[k] = (math.floor(each * r + shift) - math.floor(each * (r - 1) + shift)) * sizes[k]
    return [(total[r[2]], target[r[2]], taken[k]) for k, r in enumerate(rows)]


def divergence(rows, least=3, top=200, unit=1_000_000_000):
    """Rows of the audit of ``(text, lang, source)``."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        seen, all_n, n = Counter(), Counter(), defaultdict(Counter)
        for words_, _, source in own:
            seen.update(set(words_))
            all_n.update(words_)
            n[source].update(words_)
        kept = [t for t in all_n if seen[t] >= least]
        v = len(kept)
        share = lambda c: {t: 1 + unit * (c[t] + 1) // (sum(c[k] for k in kept) + v) for t in kept}  # noqa: E731, B023
        p, q = {s: share(n[s]) for s in n}, share(all_n)
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in n:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in n if o != s]
            terms_ = [(t, gap(p[s][t], q[t])) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms_, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return out


def copies(rows):
    """``(keep_id, group_size, kept)`` of ``(doc_id, text)`` rows; of rows that tie for the largest id any one stays."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(largest[t or ""], len(groups[t or ""])) for _, t in rows]


def phrases(rows, least=100, top=2000):
    """Rows of the phrase report of ``(text, lang)``."""
    total, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i:i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        many, inside = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, Counter()
        for p, a in many.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i:i + n]] = max(inside[p[i:i + n]], a)
        rows_ = []
        for p, a in many.items():
            if inside[p] < a:
                cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], total[lang], score))
        rows_.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows_[:top], 1)]
    return out
