"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import words

BUCKETS = 1 << 14                   # hashed words
RANK = 8                            # of the interactions
TRAIN_ROWS = 8192                   # labelled rows that the model is fitted on at most
TRAIN_WORDS = 20_000                # words of such a row at most; scoring has no such bound
SLICE_WORDS = 1 << 20               # words that are scored at a time
STATS = ("log_words", "word_length", "symbols", "capitals", "digits", "marks", "lines", "repeats", "log_chars")


def held_out(doc_id: Column) -> Column:
    """Rows whose id's CRC-32 has remainder 1 modulo 3; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, the hash bucket of each word, and the statistics of each whole text (of the empty one for NULL)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words(text).alias("w"))
    n, chars = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.length("text"), F.lit(1))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    stats = [F.log1p(F.size("w").cast("double")) / 10, F.length(F.array_join("w", "")) / n / 10, count(r"[#*$%&|<>]") / n, count("[A-Z]") / chars,
             count("[0-9]") / chars, count(r"[!?.,;:]") / n, count("\n") / n * 10, 1 - F.size(F.array_distinct("w")) / n, F.log1p(chars.cast("double")) / 12]
    buckets = F.transform("w", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return rows.select("doc_id", buckets.alias("buckets"), F.array(*[s.cast("float") for s in stats]).alias("stats"))


@dataclass
class Rows:
    """A sparse matrix in row order; the last columns are the statistics."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n: int


def to_rows(flat: np.ndarray, lengths: np.ndarray, stats: np.ndarray) -> Rows:
    """Term frequencies as unit vectors, statistics clipped to [0, 2]."""
    n = len(lengths)
    key = np.repeat(np.arange(n, dtype=np.int64), lengths) * BUCKETS + flat
    key, times = np.unique(key, return_counts=True)
    row, col, value = key // BUCKETS, key % BUCKETS, np.log1p(times).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n)) + 1e-9
    value = value / norm[row]
    wide = np.clip(np.nan_to_num(stats), 0, 2)
    return Rows(np.concatenate((row, np.repeat(np.arange(n), len(STATS)))),
                np.concatenate((col, np.tile(np.arange(BUCKETS, BUCKETS + len(STATS)), n))),
                np.concatenate((value, wide.ravel())).astype(np.float32), n)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray               # (columns,)
    factor: np.ndarray               # (columns, rank)

    def margin(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums of each row.

        All pairs of a row cost linear time: half of the square of the sum less the sum of the squares.
        """
        total = self.bias + np.bincount(x.row, self.weight[x.col] * x.value, minlength=x.n)
        sums = np.empty((x.n, self.factor.shape[1]))
        for f in range(self.factor.shape[1]):
            part = self.factor[x.col, f] * x.value
            sums[:, f] = np.bincount(x.row, part, minlength=x.n)
            total += 0.5 * (sums[:, f] ** 2 - np.bincount(x.row, part * part, minlength=x.n))
        return total, sums

    def score(self, x: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x)[0], -30, 30)))


def fit_machine(x: Rows, y: np.ndarray, epochs: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Full-gradient AdaGrad on the logistic loss, both labels weighted alike."""
    size = BUCKETS + len(STATS)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size), rng.normal(scale=0.05, size=(size, RANK)))
    ones = max(1, int(y.sum()))
    weight = np.where(y > 0, 0.5 / ones, 0.5 / max(1, len(y) - ones))
    g_bias, g_weight, g_factor = 1e-8, np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    for _ in range(epochs):
        margin, sums = m.margin(x)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        each = error[x.row] * x.value
        square = np.bincount(x.col, each * x.value, minlength=size)
        grad = np.bincount(x.col, each, minlength=size) + decay * m.weight
        bias = error.sum()
        g_bias += bias * bias
        g_weight += grad * grad
        m.bias -= rate * bias / np.sqrt(g_bias)
        m.weight -= rate * grad / np.sqrt(g_weight)
        for f in range(RANK):
            grad = np.bincount(x.col, each * sums[x.row, f], minlength=size) - square * m.factor[:, f] + decay * m.factor[:, f]
            g_factor[:, f] += grad * grad
            m.factor[:, f] -= 0.3 * rate * grad / np.sqrt(g_factor[:, f])
    return m


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, label: str = "quality") -> Machine:
    """The model of at most ``train_rows`` labelled rows that are not held out, those with the smallest id hashes.

    Of these, rows of more than ``TRAIN_WORDS`` words are left out, so the sample that the driver fits is bounded in bytes too.
    Ids with several labels take the greatest, NULL ids and labels are passed over.  Without rows of both labels the model is
    the constant 0.5 plus untrained, near-zero terms.
    """
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")                   # ``train_rows`` rows at most
    sample = features(rows).filter(F.size("buckets") <= TRAIN_WORDS).join(F.broadcast(chosen), "doc_id").select("doc_id", "buckets", "stats", "y").toArrow()
    sample = sample.sort_by([("doc_id", "ascending")])
    y = sample["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Machine(0.0, np.zeros(BUCKETS + len(STATS)), np.zeros((BUCKETS + len(STATS), RANK)))
    return fit_machine(_matrix(sample["buckets"].combine_chunks(), sample["stats"].combine_chunks()), y)


def _matrix(buckets: pa.ListArray, stats: pa.ListArray) -> Rows:
    lengths = buckets.value_lengths().to_numpy(zero_copy_only=False)
    return to_rows(buckets.flatten().to_numpy(), lengths, stats.flatten().to_numpy().reshape(len(buckets), len(STATS)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every input row.

    NULL and empty texts are scored by their statistics alone; repeated rows and NULL ids stay, an empty table gives none, and
    other columns are left out.  A row's score depends on its text only.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))   # (2**14 + 9) x (1 + rank) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Machine(*shared.value)
        for batch in batches:
            buckets, stats = batch.column("buckets"), batch.column("stats")
            ends = np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False)) if len(batch) else np.zeros(0, int)
            out, begin = [], 0
            while begin < len(batch):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + SLICE_WORDS, side="right")))
                out.append(known.score(_matrix(buckets.slice(begin, end - begin), stats.slice(begin, end - begin))))
                begin = end
            found = np.concatenate([np.zeros(0), *out])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found),
                                              pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = features(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "buckets", "stats")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
