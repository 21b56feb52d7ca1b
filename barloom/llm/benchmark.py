"""Benchmark decontamination: test n-gram windows looked up in every document window."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import packed, unpacked
from barloom.operators.ordered import settle

WINDOW = 13
PERCENT = 5                         # of a document's words that make it contaminated
BLOCK_WORDS = 2_000_000             # benchmark words that one broadcast holds
SLICE_BYTES = 1 << 20               # text that is hashed at a time
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")    # of ASCII lower-case UTF-8 bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[ord("0"):ord("9") + 1] = True
_IN_WORD[ord("a"):ord("z") + 1] = True
_IN_WORD[0x80:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)        # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def tokens(text: str | None) -> list[bytes]:
    """Normalised words of one text as UTF-8; none for NULL."""
    return WORD.findall((text or "").encode().lower())


def windows_of(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    """Runs of 13 words; a shorter item is one window, an empty one none."""
    size = min(WINDOW, len(words))
    for i in range(len(words) - size + 1 if size else 0):
        yield tuple(words[i:i + size])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hash_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word; a word also ends where a text begins (``breaks``)."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    before, after = np.roll(inside, 1), np.roll(inside, -1)
    before[:1] = after[-1:] = False
    before[breaks] = after[breaks - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    weighted = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(low)), dtype=np.uint64, out=weighted[1:])
    return _mix((weighted[ends] - weighted[starts]) * _powers(_BACK, len(low) + 1)[starts]), starts, ends


def word_hashes(data: np.ndarray, bounds: np.ndarray, piece: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the texts ``data[bounds[i]:bounds[i + 1]]``, and the words of each text.

    Data are hashed in pieces of about ``piece`` bytes cut between words, so a very long text costs memory by
    its words alone.
    """
    out, begin, piece = [], 0, piece or SLICE_BYTES
    while begin < len(data):
        end = min(begin + piece, len(data))
        while end < len(data) and _IN_WORD[_LOWER[data[end]]]:
            end += 1
        hashes, starts, ends = _hash_piece(data[begin:end], bounds[(bounds > begin) & (bounds < end)] - begin)
        out.append((hashes, starts + begin, ends + begin))
        begin = end
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes, starts, ends = (np.concatenate(x) for x in zip(none, *out))
    return hashes, starts, ends, np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs over a text's end are the caller's to skip."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * _STEP + words[i:i + n]
    return _mix(out)


class Block:
    """A bounded part of the benchmark: windows by length, hash and words."""

    def __init__(self):
        self.items: dict[int, dict[int, dict[tuple[bytes, ...], set[str]]]] = defaultdict(lambda: defaultdict(dict))
        self.words = 0

    def add(self, item: str, words: list[bytes]) -> None:
        self.words += len(words) * (min(WINDOW, len(words)))
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        hashes = word_hashes(data, np.array([0, len(data)]))[0]
        size = min(WINDOW, len(words))
        for h, window in zip(window_hashes(hashes, size).tolist() if size else (), windows_of(words)):
            self.items[size][h].setdefault(window, set()).add(item)

    def frozen(self) -> list[tuple[int, np.ndarray, np.ndarray, dict]]:
        """For each window length: sorted hashes, a bit table that most other hashes miss, and the windows."""
        out = []
        for size, by_hash in sorted(self.items.items()):
            keys = np.array(sorted(by_hash), dtype=np.uint64)
            bits = np.zeros(1 << max(16, min(24, int(len(keys) * 32).bit_length())), dtype=bool)
            bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            out.append((size, keys, bits, {h: dict(w) for h, w in by_hash.items()}))
        return out


def blocks_of(bench: DataFrame, block_words: int) -> Iterator[list]:
    """The benchmark in parts of at most about ``block_words`` window words (one item at least)."""
    block = Block()
    for item, text in bench.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = tokens(text)
        if block.words and block.words + len(words) * WINDOW > block_words:
            yield block.frozen()
            block = Block()
        block.add(item or "", words)
    yield block.frozen()


def _scan(data: np.ndarray, bounds: np.ndarray, block: list) -> tuple[list[tuple[int, int, int, set[str]]], np.ndarray]:
    """Verified hits of a slice as (text, first word, words, items), and the number of words of each text."""
    words, starts, ends, counts = word_hashes(data, bounds)
    first, found = np.concatenate(([0], np.cumsum(counts))), []
    for size, keys, bits, by_hash in block:
        hashes = window_hashes(words, size)
        at = np.flatnonzero(bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)])
        near = np.searchsorted(keys, hashes[at])
        at = at[(near < len(keys)) & (keys[np.minimum(near, len(keys) - 1)] == hashes[at])] if len(keys) else at[:0]
        text = np.searchsorted(first, at, side="right") - 1
        fits = at + size <= first[text + 1]
        for i, t in zip(at[fits].tolist(), text[fits].tolist()):
            window = tuple(data[starts[k]:ends[k]].tobytes().lower() for k in range(i, i + size))
            items = by_hash[int(hashes[i])].get(window)
            if items:
                found.append((t, i - int(first[t]), size, items))
    return found, counts


def _marks(data: np.ndarray, offsets: np.ndarray, block: list) -> tuple[np.ndarray, dict]:
    """Words of each text, and hits by text, slice by slice of whole texts."""
    n = len(offsets) - 1
    counts, hits, begin = np.zeros(n, dtype=np.int64), defaultdict(list), 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, side="right")) - 1)
        lo, hi = int(offsets[begin]), int(offsets[end])
        found, counts[begin:end] = _scan(data[lo:hi], offsets[begin:end + 1] - lo, block)
        for t, j, size, items in found:
            hits[begin + t].append((j, size, items))
        begin = end
    return counts, hits


def _merged(hits: list) -> list[tuple[int, int]]:
    """Disjoint word intervals that the hits cover."""
    out: list[list[int]] = []
    for j, size, _ in sorted(hits, key=lambda h: (h[0], h[1])):
        if out and j <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j + size)
        else:
            out.append([j, j + size])
    return [tuple(x) for x in out]


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                    ("items", pa.list_(pa.string()))])
_FOUND_SQL = "struct<n_words:bigint,spans:array<struct<from:int,to:int>>,items:array<string>>"


def _pass(shared):
    """One pass over the rows with one block; adds to what earlier passes found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            text = batch.column("text")
            text = pa.concat_arrays([text.fill_null("")]).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            counts, hits = _marks(data, offsets, block) if len(text) else (np.zeros(0, np.int64), {})
            found = [{"n_words": n, "spans": [], "items": []} for n in counts.tolist()]
            earlier = batch.column("found")
            for i in range(len(found)):
                old = earlier[i].as_py() if earlier.null_count < len(found) else None
                if hits.get(i) or old and old["spans"]:
                    both = hits.get(i, []) + [(s["from"], s["to"] - s["from"], ()) for s in (old or {"spans": []})["spans"]]
                    found[i]["spans"] = [{"from": a, "to": b} for a, b in _merged(both)]
                    found[i]["items"] = sorted({x for _, _, items in both for x in items} | set(old["items"] if old else ()))
            columns = [pa.array(found, _FOUND) if n == "found" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return run


def search(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every input row as ``row`` with ``found``: its words, the word intervals hit, and the items hit.

    The windows of the benchmark are a broadcast set.  A broadcast holds at most ``block_words`` window words; a larger
    benchmark is searched block by block, each pass adding to the row and writing it, so a task holds one block and neither rows
    nor windows are lost.
    Hits of the hash set are verified word by word.  NULL and empty texts have no words and no hits, and neither
    have items without words; items of one id are one item, those with a NULL id one with an empty id.
    Repeated rows stay, an empty table or benchmark gives no hits, and other columns pass in ``row``.
    """
    rows = packed(docs, F.col("text"), F.lit(None).cast(_FOUND_SQL).alias("found"))
    for i, block in enumerate(blocks_of(bench, block_words)):
        rows = settle(rows) if i else rows                  # one stage would hold the blocks of all passes at once
        rows = rows.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(block)), rows.schema)
    return rows.select("row", "text", "found")


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + (s["to"] - s["from"]))
    rows = found.select("*", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"),
                        F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= PERCENT * F.col("n_words")))


def clean(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The input rows without the contaminated ones; a shorter passage below the threshold stays."""
    rows = with_verdict(search(docs, bench, block_words)).filter("not contaminated")
    return unpacked(rows, docs)


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the given word intervals."""
    if not text or not spans:
        return text
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, end = [], 0
    for a, b in spans:
        out.append(data[end:at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, data[end:]]).decode()


def without_passages(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The input rows, passages of the benchmark cut out of ``text`` instead of whole documents."""
    found = search(docs, bench, block_words)

    def run(batches):
        for frame in batches:
            frame["text"] = [cut(t, [(s["from"], s["to"]) for s in spans]) for t, spans in zip(frame["text"], frame["spans"])]
            yield frame[["row", "text"]]

    rows = found.select("row", "text", F.col("found.spans").alias("spans"))
    changed = rows.mapInPandas(run, found.select("row", "text").schema)
    return unpacked(changed, docs, text=F.col("text"))
