"""Phrases that stand together more often than chance: dynamic itemset counting over cyclic shard scans.

The documents are dealt to shards, their words numbered once, and each scan reads the next shard, all lengths at once.  A word is counted from the
first scan on; a longer phrase becomes active in the scan after both its subphrases, without the last and without the
first word, have reached the threshold, and is counted for one full cycle, so its count is exact whenever it began.

What has reached the threshold is known to a scan by a table of fixed size: the scan in which a cell was first reached.
A phrase whose cell was reached for another one is merely counted early or in vain; its cycle is as long and
its count as exact, since cells never change once they are set and the start follows from them alone: it is the scan
after both parts have their cell set and have begun themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import top_rows
from barloom.operators.ordered import settle, shared_path

LONGEST = 5                         # words
LEAST = 100                         # occurrences
TOP = 2000                          # phrases of a language
SHARDS = 3
CELL_BITS = 24                      # a table of 16 MB
PACK_WORDS = 1 << 22                # words of the texts that are numbered together
BLOCK_WORDS = 1 << 22               # words that a task counts together
PIECE = 1 << 22                     # bytes that are split at a time
BATCH_ROWS = 1 << 16
NEVER = 255                         # cell that nothing has reached
_ID_BITS = 23                       # of a word's number in a block

_BREAK = b"\xff"                    # between pieces; no byte of UTF-8
#: Small letters for A to Z, blanks for the blank and the tab, line ends for all that ends a piece.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 9 else 0x0A if c in b".,;:!?" or 0x0A <= c <= 0x0D else c for c in range(256))


class _Numbers(dict):
    """Numbers of words in the order in which they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _numbered(text: bytes, numbers: Callable[[], _Numbers]) -> Iterator[np.ndarray]:
    """Word numbers of a text, part by part."""
    clean, at = text.translate(TABLE).replace(b"\n", b" \xff ") + b" \xff", 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        yield np.fromiter(map(numbers().__getitem__, words), np.int32, count=len(words))
        at = end


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that of its last word."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _later(cell: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Scan from whose end on a phrase counts as reached: never before it was active itself."""
    return np.where(cell == NEVER, NEVER, np.maximum(cell, start)).astype(np.uint8)


def _distinct(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One position and the number of occurrences of each distinct phrase of ``size`` words among those at ``at``."""
    code, room = ids[at].astype(np.int64), 63 - _ID_BITS
    for i in range(1, size):
        if room < _ID_BITS:                                 # number what was joined so far
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            room = 63 - _ID_BITS
        code = code << _ID_BITS | ids[at + i]
        room -= _ID_BITS
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks ``shard, lang, words, hashes, ids, tail``: the words of many texts as numbers, and each distinct word once.

    ``ids`` has 0 between pieces. A text that goes on in the next block leaves its last words in both; they are the ``tail``
    of the first, in which no phrase begins.
    """
    held, size, digest = {}, 0, xxhash.xxh64_intdigest

    def block(key, tail: int = 0):
        (shard, lang), (numbers, arrays) = key, held.pop(key)
        seed, words = digest(lang.encode()), list(numbers)
        hashes = np.fromiter((digest(w, seed) for w in words), np.uint64, count=len(words))
        ids = np.concatenate(arrays)
        tail = min(tail, len(ids))
        if tail:
            rest = _Numbers()
            held[key] = rest, [np.array([rest[words[i]] for i in ids[len(ids) - tail:]], np.int32)]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([hashes.tobytes()], pa.binary()),
             pa.array([ids.tobytes()], pa.binary()), pa.array([tail], pa.int32())], names=["shard", "lang", "words", "hashes", "ids", "tail"])

    for batch in batches:
        for shard, lang, text in zip(batch["shard"].to_pylist(), batch["lang"].to_pylist(), batch["text"]):
            key, long = (shard, lang), 0
            held.setdefault(key, (_Numbers(), []))
            for ids in _numbered(text.as_py(), lambda: held[key][0]):
                held[key][1].append(ids)
                size, long = size + len(ids), long + len(ids)
                if long >= PACK_WORDS:
                    yield block(key, LONGEST - 1)
                    size, long = size - long, 0
            if size >= PACK_WORDS:
                yield from [block(k) for k in list(held)]
                size = 0
    yield from [block(k) for k in list(held)]


def count_block(ids: np.ndarray, fresh: np.ndarray, names: pa.Array, of_word: np.ndarray, reached: np.ndarray, step: int, shards: int) -> Iterator[tuple]:
    """``(phrases, counts, cells, starts)`` of all phrases that are active in this scan and begin at a ``fresh`` place, by length.

    ``ids`` are word numbers with 0 between pieces.
    """
    word_cells = _cells(of_word)
    since = reached[word_cells].copy()
    since[0] = NEVER
    if step <= shards:
        n = np.bincount(ids[fresh], minlength=len(names))
        n[0] = 0
        own = np.flatnonzero(n)
        yield names.take(pa.array(own)), n[own], word_cells[own], np.ones(len(own), np.int64)
        yield pa.array([b""], pa.binary()), n.sum(keepdims=True), np.zeros(1, np.int64), np.ones(1, np.int64)
    at = np.flatnonzero(since[ids] != NEVER)
    hashes, since = of_word[ids[at]], since[ids[at]]
    for size in range(2, LONGEST + 1):
        both = np.flatnonzero(at[1:] == at[:-1] + 1)        # a phrase, and the one that starts a word later
        if not len(both):
            return
        start = np.maximum(since[both], since[both + 1]).astype(np.int64) + 1
        at = at[both]
        hashes = _mixed(hashes[both], of_word[ids[at + size - 1]])
        active = np.flatnonzero((start + shards > step) & fresh[at])
        if len(active):
            first, n = _distinct(ids, at[active], size)
            where = np.searchsorted(at, first)
            parts = [names.take(pa.array(ids[first + i])) for i in range(size)]
            yield pc.binary_join_element_wise(*parts, b" "), n, _cells(hashes[where]), start[where]
        since = _later(reached[_cells(hashes)], start)
        known = np.flatnonzero(since < step)                # a phrase that began in this scan serves from the next one on
        at, hashes, since = at[known], hashes[known], since[known]


def _merged(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Blocks of one language as one: ids in common numbers, where phrases may begin, the words and their hashes."""
    words = pa.concat_arrays([w for w, *_ in blocks]).dictionary_encode()
    number = words.indices.to_numpy()
    of_word = np.empty(len(words.dictionary), np.uint64)
    of_word[number] = np.concatenate([h for _, h, *_ in blocks])
    ids, fresh, at = [], [], 0
    for own, _, numbers, tail in blocks:
        ids += [number[at:at + len(own)][numbers], np.zeros(1, number.dtype)]
        fresh += [np.arange(len(numbers)) < len(numbers) - tail, np.zeros(1, bool)]
        at += len(own)
    return np.concatenate(ids), np.concatenate(fresh), words.dictionary, of_word


def _scan(step: int, shards: int, table):
    """Worker function: rows ``lang, phrase, n, cell, start`` of the phrases that are active in this scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, held, size = table.value, {}, 0

        def counted():
            for lang, blocks in held.items():
                for phrase, n, cell, start in count_block(*_merged(blocks), reached, step, shards):
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), phrase, pa.array(n, pa.int64()),
                               pa.array(cell.astype(np.int32)), pa.array(start.astype(np.int32))]
                    whole = pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n", "cell", "start"])
                    for a in range(0, len(n), BATCH_ROWS):
                        yield whole.slice(a, BATCH_ROWS)
            held.clear()

        for batch in batches:
            for lang, words, hashes, ids, tail in zip(*[batch[c] for c in ("lang", "words", "hashes", "ids", "tail")]):
                numbers = np.frombuffer(ids.as_buffer(), np.int32)
                held.setdefault(lang.as_py(), []).append((words.values, np.frombuffer(hashes.as_buffer(), np.uint64), numbers, tail.as_py()))
                size += len(numbers)
                if size >= BLOCK_WORDS:
                    yield from counted()
                    size = 0
        yield from counted()
    return run


def _n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def _reached_cells(reached: DataFrame) -> np.ndarray:
    """Distinct cells as numbers, fetched as bitmaps: never more than the table has cells, 2 MB of bits."""
    cell = F.col("cell").cast("bigint") + 1                  # bitmaps start at 1
    parts = reached.groupBy(F.bitmap_bucket_number(cell).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    found = [(p.part - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(p.bits, np.uint8), bitorder="little")) for p in parts]
    return np.concatenate([np.zeros(0, np.int64), *found])


def frequent(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, n`` of all phrases of up to five words with at least ``least`` occurrences, and the number of all words as phrase ``''``.

    ``shards`` is 2 at least.  Each scan writes the counts of the phrases whose cycle is not complete; a lost executor costs a part of one scan.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "shards")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                       F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    schema = "shard int, lang string, words array<binary>, hashes binary, ids binary, tail int"
    rows.mapInArrow(_packed, schema).write.partitionBy("shard").parquet(path)
    dealt = spark.read.schema(schema).parquet(path)
    table = np.full(1 << CELL_BITS, NEVER, np.uint8)
    step, last, open_, done = 0, 0, None, []
    while step < max(shards, last + shards):
        step += 1
        shared = spark.sparkContext.broadcast(table)
        seen = dealt.filter(F.col("shard") == (step - 1) % shards).drop("shard")
        counts = (seen.mapInArrow(_scan(step, shards, shared), "lang string, phrase binary, n bigint, cell int, start int")
                  .withColumn("phrase", F.col("phrase").cast("string")))
        counts = counts if open_ is None else counts.unionByName(open_)
        complete = F.col("start") + (shards - 1) == step
        enough = (F.col("n") >= least) | (F.col("phrase") == "")
        # Dealt before they are added up: a task's rows are distinct already, so adding them there would find nothing.
        counts = settle(counts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("cell").alias("cell"), F.max("start").alias("start"))
                        .filter(~complete | enough))
        done.append(counts.filter(complete & enough).select("lang", "phrase", "n"))
        open_ = counts.filter(~complete)
        cells = _reached_cells(counts.filter((F.col("n") >= least) & (F.col("phrase") != "") & (_n_words(F.col("phrase")) < LONGEST)))
        shared.destroy()
        cells = cells[table[cells] == NEVER]
        if len(cells):
            table, last = table.copy(), step
            table[cells] = step
        # A part whose cell was set for another phrase serves only after it has begun itself.
        later = counts.filter((F.col("start") > last) & (F.col("phrase") != "") & (_n_words(F.col("phrase")) < LONGEST))
        starts = [s for (s,) in later.select("start").distinct().collect()] if last < step else []       # ``shards`` numbers at most
        last = max([last, *[s for s in starts if (table[_reached_cells(later.filter(F.col("start") == s))] != NEVER).any()]])
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return settle(found)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language that hold together best.

    A phrase is cut where its parts explain it best; of equal cuts the first counts.  A phrase that stands as often within
    a longer one is left out.  Ranks go by score, then occurrences, then the bytes of the phrase.  NULL text is empty, NULL
    language ``und``; repeated rows count again, a phrase never crosses the end of a piece or a text, and very long texts
    are read in parts that overlap.  An empty table gives none; other columns are not read.
    """
    found = frequent(docs, least, shards)
    totals = found.filter("phrase = ''").select("lang", F.col("n").alias("all"))
    phrases = found.filter("phrase <> ''").select("lang", "phrase", "n", F.split("phrase", " ").alias("words"))
    many = phrases.filter(F.size("words") > 1)
    part = lambda a, size: F.array_join(F.slice("words", a, size), " ")
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a", 17) * wide("all", 17), wide("l", 19) * wide("r", 19))
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "all")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    size = F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    inside = many.filter(F.size("words") > 2).select("lang", "n", "words", size)
    inside = inside.select("lang", "n", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    inside = inside.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("n").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all").alias("n"), F.col("cut.score").alias("score"))
    ranked = top_rows(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
