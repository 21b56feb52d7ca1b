"""Secret scans: credential patterns, and values in credential contexts that are costly to guess."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "guess")
LEAST_LOG10 = 10.0                  # guesses from which a value counts as a secret

_SECRET = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = {"assign": re.compile(_SECRET, re.ASCII), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
_LEAST = {"assign": 6, "access": 20, "hex": 24}
#: An identifier with a sign or "is" after it, or "bearer", before a value; identifiers are taken whole, so a text is read once.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9_.-])(?:((?:(?i:api|access|auth|client|pass|private|secret|session)\x20(?=(?i:code|id|key|phrase|word)\b))?[A-Za-z0-9_.-]++)"""
    r"""["']?[\x20\t]*(?:[:=]++>?|(?i:is)\b[\x20\t]*[:=]*+)|(?i:bearer)\b)[\x20\t]*["']?(?=[^\s"'<>,;])""", re.ASCII)
_GIVEN = re.compile(r"""[^\s"'<>,;]+""", re.ASCII)
#: What the identifier of a credential contains, whatever stands before and after it; short words stand alone in it.
_WORD = re.compile(
    r"(?i:passw|pass[ _.-]?(?:phrase|code|word)|pwd|secret(?!ar)|token(?!i[sz])|credential|api[ _.-]?key|client[ _.-]?id|session[ _.-]?id|(?:access|auth|private)[ _.-]?key|authorization)"
    r"|(?:(?<![A-Za-z])(?i:pass|pin|auth|login|bearer|creds?)|(?<=[a-z])(?:Pass|Pin|Auth|Login|Creds?))(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))", re.ASCII)
#: What a text with any match contains; NULL and other texts are not sent to Python.
MAY = (r"(?i:pass|pwd|secret|token|credential|\bcreds?|_creds?|auth|bearer|login|api[ _.-]?key|client[ _.-]?id|session[ _.-]?id|(?:access|private)[ _.-]?key)"
       r"|(?<![A-Za-z])(?i:pin)(?![a-z])|[a-z](?:Pin|Cred)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")

# Frequent passwords and words in order of frequency; the rank is the guess count.
COMMON = ("password 123456 qwerty admin welcome letmein monkey dragon master login abc123 iloveyou secret shadow sunshine princess "
          "football baseball superman batman trustno1 hello freedom whatever test guest root user default changeme pass access "
          "the and you that was for are with his they this have from one had word but not what all were when your can said there "
          "use each which she how their will other about out many then them these some her would make like him into time has look "
          "two more write see number way could people than first water been call who oil its now find long down day did get come "
          "made may part key token server client service system data base cloud example company summer winter spring autumn").split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")          # fixed: keyboard rows from left to right
_NEXT = {(a, b) for row in ROWS for pair in zip(row, row[1:]) for a, b in (pair, pair[::-1])}
_NEXT |= {(a, b) for up, low in zip(ROWS, ROWS[1:]) for pair in zip(up, low) for a, b in (pair, pair[::-1])}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_LONGEST_WORD = max(map(len, COMMON))


def _brute(c: str) -> float:
    """log10 of the alphabet that a character is guessed from."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class _Starts:
    """Starts ``(i, b)`` of a run's segments; the cheapest end in ``j`` costs ``b + times * log10(j - i)``.

    Starts come in order.  A later start is passed by an earlier, cheaper one at most once, so the starts that may still be
    cheapest form a stack whose top is the cheapest now, and all work is linear in the number of starts.
    """

    def __init__(self, times: int):
        self.times, self.kept = times, []

    def add(self, i: int, b: float) -> None:
        kept = self.kept
        while kept and kept[-1][1] >= b:
            kept.pop()
        if kept and b - kept[-1][1] > 20 * self.times:              # no value has 10^20 characters
            return
        while len(kept) > 1 and self._passed(kept[-2], kept[-1]) <= self._passed(kept[-1], (i, b)):
            kept.pop()
        kept.append((i, b))

    def _passed(self, early: tuple[int, float], late: tuple[int, float]) -> float:
        """From which end on ``early`` is cheaper."""
        ratio = 10 ** min((late[1] - early[1]) / self.times, 300)
        return (ratio * late[0] - early[0]) / (ratio - 1) if ratio > 1 else math.inf

    def _cost(self, start: tuple[int, float], j: int) -> float:
        return start[1] + self.times * math.log10(j - start[0])

    def cost(self, j: int) -> float:
        kept = self.kept
        while len(kept) > 1 and self._cost(kept[-2], j) <= self._cost(kept[-1], j):
            kept.pop()
        return self._cost(kept[-1], j) if kept else math.inf


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans.

    ``best[i]`` is the least sum of segment costs for the first ``i`` characters; each further segment multiplies the
    guesses by its own count and by the number of places a segment may take.  Time is linear in the length: words and dates
    are bounded, and of each run of repeats, neighbouring keys or consecutive characters only the cheapest start is asked.
    """
    n, low, join = len(value), value.lower(), math.log10(2)
    best = [0.0] + [math.inf] * n
    brute = [_brute(c) for c in value]
    here = [0.0] * (n + 1)                                          # the cost of the characters before a segment
    same, walk, order, step = [0] * 5, 1, 1, 0                      # lengths of the runs that end here
    units = [[_Starts(1) for _ in range(w)] for w in range(5)]      # by width, then by start modulo width
    walks, orders = _Starts(2), _Starts(1)
    for j in range(n + 1):
        for w in (1, 2, 3, 4) if j > 1 else ():                     # a unit, repeated
            if j > w and value[j - 1] == value[j - 1 - w]:
                same[w] += 1
                if same[w] >= w:
                    starts = units[w][j % w]
                    starts.add(j - 2 * w, here[j - 2 * w])
                    best[j] = min(best[j], starts.cost(j) + sum(brute[j - w:j]) - math.log10(w))
            elif same[w]:
                same[w], units[w] = 0, [_Starts(1) for _ in range(w)]
        if j > 1:
            if (low[j - 2], low[j - 1]) in _NEXT:                     # a walk over neighbouring keys
                walk += 1
                if walk >= 3:
                    walks.add(j - 3, here[j - 3])
                    best[j] = min(best[j], walks.cost(j) + math.log10(len(ROWS) * 10))
            elif walk > 1:
                walk, walks = 1, _Starts(2)
            last, step = step, ord(value[j - 1]) - ord(value[j - 2])
            if abs(step) != 1:
                order = 1
            elif step == last:                                      # a sequence such as abcd or 4321
                order += 1
                if order == 3:
                    orders = _Starts(1)
                orders.add(j - 3, here[j - 3])
                best[j] = min(best[j], orders.cost(j) + math.log10(36 * 2))
            else:
                order = 2
        if j == n:
            break
        here[j] = best[j] + (join if j else 0.0)
        best[j + 1] = min(best[j + 1], here[j] + brute[j])
        for k in range(j + 3, min(n, j + _LONGEST_WORD) + 1):
            rank = RANK.get(low[j:k])
            if rank:
                capitals = sum(a != b for a, b in zip(value[j:k], low[j:k]))
                best[k] = min(best[k], here[j] + (math.log10(rank) + math.log10(1 + capitals) * 2))
        m = _DATE.match(value, j)
        if m:
            best[m.end()] = min(best[m.end()], here[j] + (math.log10(365 * 120) if m.end() - j > 4 else math.log10(120)))
    return best[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's matches, leftmost and non-overlapping within each kind, by start, then kind."""
    found = []
    for k, (kind, pattern) in enumerate(_PATTERNS.items()):
        for m in pattern.finditer(text):
            size = len(m[2]) if kind == "assign" else m.end() - m.start()
            if size >= _LEAST[kind]:
                found.append((m.start(), k, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def guessed_spans(text: str, base: list[tuple[str, int, int]], least: float = LEAST_LOG10) -> list[tuple[str, int, int]]:
    """Values in credential contexts whose guess cost is ``least`` or more and that no base span touches; of nested contexts the first counts."""
    out, done = [], 0
    for m in _CONTEXT.finditer(text):
        if m.end() < done or m[1] and not _WORD.search(m[1]):
            continue
        a, done = _GIVEN.match(text, m.end()).span()
        if done - a >= 6 and not any(a < end and done > start for _, start, end in base) and guess_cost(text[a:done]) >= least:
            out.append(("guess", a, done))
    return out


def spans_of(text: str | None, least: float = LEAST_LOG10) -> list[tuple[str, int, int]]:
    base = base_spans(text or "")
    both = base + guessed_spans(text or "", base, least)
    return sorted(both, key=lambda s: (s[1], KINDS.index(s[0])))


_FOUND = "doc_id {}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, costs string"


def _rows(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                spans = spans_of(text, least)
                base = [s for s in spans if s[0] != "guess"]
                counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                costs = ",".join(f"{guess_cost(_value(text, s)):.2f}" for s in spans)
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), costs))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "costs"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out
    return run


def _value(text: str, span: tuple[str, int, int]) -> str:
    part = text[span[1]:span[2]]
    m = _PATTERNS["assign"].match(part) if span[0] == "assign" else None
    return m[2] if m else part


def scan(docs: DataFrame, least: float = LEAST_LOG10) -> DataFrame:
    """Counts, digest, all spans and their guess costs of every input row.

    NULL and empty texts have no spans; repeated rows and NULL ids stay, an empty table gives none, and other columns are
    left out.  Spans count code points.  Texts that cannot match are recognised in the JVM and reach Python as NULL.
    """
    rows = docs.select("doc_id", F.when(F.col("text").rlike(MAY), F.col("text")).alias("text"))
    return rows.mapInPandas(_rows(least), _FOUND.format(docs.schema["doc_id"].dataType.simpleString()))
