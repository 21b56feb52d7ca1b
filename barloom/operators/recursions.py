"""Recursions whose coefficients depend on the data.

``affine``: ``y = a_t * y + b_t``.  Affine maps compose, so chunks reduce to one
``(A, B)`` pair each, pairs reduce the same way, and the carry flows back down.

``recursive``: a nonlinear step with a small state.  Every chunk starts from a
guess warmed up on the rows before it, all chunks run in parallel, and chunks
whose guess disagrees with the true state of the chunk before are run again
from that state until every boundary agrees.  The result equals one pass over
the whole series, and no task holds more than a chunk and its warm-up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.operators.ordered import BARS, Layout, index_rows, settle

_FAN = 4_096  # chunk summaries handled by one task on the way up


def _walk(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    out = []
    for p, q in zip(a.tolist(), b.tolist()):
        y = p * y + q
        out.append(y)
    return np.array(out)


def _compose(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    p, q = 1.0, 0.0
    for x, z in zip(a.tolist(), b.tolist()):
        p, q = x * p, x * q + z
    return p, q


def _reduce(df: DataFrame, keys: list[str], order: str, key_types: str) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p, q = _compose(pdf["_a"].to_numpy(float), pdf["_b"].to_numpy(float))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_a": [p], "_b": [q]})

    return df.groupBy(*keys).applyInPandas(fold, f"{key_types}, _a double, _b double")


def _spread(df: DataFrame, keys: list[str], order: str, outer: DataFrame | None, key_types: str, out_key: str) -> DataFrame:
    """Carry-in per ``order`` row inside each group of ``keys`` given the group's own carry-in."""
    if outer is None:
        df = df.withColumn("_y0", F.lit(0.0))
    else:
        df = df.join(outer, keys)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        start = float(pdf["_y0"].iloc[0])
        ends = _walk(pdf["_a"].to_numpy(float), pdf["_b"].to_numpy(float), start)
        carry = np.concatenate([[start], ends[:-1]])
        return pd.DataFrame({**{k: pdf[k] for k in dict.fromkeys([*keys, order])}, "_y0": carry})

    types = key_types if order in keys else f"{key_types}, {out_key} bigint"
    return df.groupBy(*keys).applyInPandas(scan, f"{types}, _y0 double")


def affine(df: DataFrame, a: str, b: str, out: str, layout: Layout = BARS) -> DataFrame:
    """``y_t = a_t y_(t-1) + b_t`` from ``y = 0`` before the first row."""
    key = list(layout.key)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    base = settle(index_rows(df, layout)).withColumn("_chunk", F.floor(F.col("_i") / layout.rows))
    slim = base.select(*key, "_chunk", "_i", F.coalesce(a, F.lit(1.0)).alias("_a"), F.coalesce(b, F.lit(0.0)).alias("_b"))
    chunks = _reduce(slim, [*key, "_chunk"], "_i", f"{types}, _chunk bigint")
    chunks = chunks.withColumn("_group", F.floor(F.col("_chunk") / _FAN))
    groups = _reduce(chunks, [*key, "_group"], "_chunk", f"{types}, _group bigint")
    carry_g = _spread(groups, key, "_group", None, types, "_group")
    carry_c = _spread(chunks, [*key, "_group"], "_chunk", carry_g, f"{types}, _group bigint", "_chunk").drop("_group")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        pdf["_y"] = _walk(pdf["_a"].to_numpy(float), pdf["_b"].to_numpy(float), float(pdf["_y0"].iloc[0]))
        return pdf[[*key, "_i", "_y"]]

    y = (slim.join(carry_c, [*key, "_chunk"]).groupBy(*key, "_chunk")
         .applyInPandas(run, f"{types}, _i bigint, _y double"))
    return base.drop("_chunk", out).join(y.withColumnRenamed("_y", out), [*key, "_i"])


# ---- nonlinear kernels: (values, period, state or None) -> (outputs, states after each row) -----

def mcginley(x: np.ndarray, n: int, state):
    y = None if state is None else state[0]
    out, states = [], []
    for v in x.tolist():
        if y is None:
            y = v
        else:
            scale = n * (v / (y if y != 0.0 else 1.0)) ** 4
            if math.isfinite(scale) and abs(scale) >= 1e-12:
                y = y + (v - y) / scale
        out.append(y)
        states.append([y])
    return out, states


def ahrens(x: np.ndarray, n: int, state):
    """Mean of the value n rows back and the latest one as the reference level."""
    hist = [] if state is None else list(state)
    out, states = [], []
    for v in x.tolist():
        if not hist:
            y = v
        else:
            y = hist[-1] + (v - (hist[-1] + hist[0]) / 2.0) / n
        hist = (hist + [y])[-n:]
        out.append(y)
        states.append(list(hist))
    return out, states


# Fixed values of the adaptive cycle average: alpha limits and the Hilbert weights.
_FAST, _SLOW = 0.5, 0.05
_HILBERT = (0.0962, 0.5769, -0.5769, -0.0962)


def mesa(x: np.ndarray, n: int, state):
    """Adaptive average whose alpha follows the phase speed of the measured cycle."""
    if state is None:
        price, smooth, det, i1s, q1s = [], [], [], [], []
        i2 = q2 = re = im = period = phase = 0.0
        mama = None
    else:
        s = list(state)
        price, smooth, det, i1s, q1s = (s[k * 7:(k + 1) * 7] for k in range(5))
        i2, q2, re, im, period, phase, mama = s[35:42]
    price, smooth, det, i1s, q1s = ([0.0] * (7 - len(b)) + b for b in (price, smooth, det, i1s, q1s))

    def hilbert(b, k):
        return sum(w * b[-1 - 2 * j] for j, w in enumerate(_HILBERT)) * k

    out, states = [], []
    for v in x.tolist():
        price = price[1:] + [v]
        smooth = smooth[1:] + [(4 * price[-1] + 3 * price[-2] + 2 * price[-3] + price[-4]) / 10.0]
        k = 0.075 * period + 0.54
        det = det[1:] + [hilbert(smooth, k)]
        q1, i1 = hilbert(det, k), det[-4]
        i1s, q1s = i1s[1:] + [i1], q1s[1:] + [q1]
        ji, jq = hilbert(i1s, k), hilbert(q1s, k)
        i2n, q2n = 0.2 * (i1 - jq) + 0.8 * i2, 0.2 * (q1 + ji) + 0.8 * q2
        re, im = 0.2 * (i2n * i2 + q2n * q2) + 0.8 * re, 0.2 * (i2n * q2 - q2n * i2) + 0.8 * im
        i2, q2 = i2n, q2n
        p = period
        if im != 0.0 and re != 0.0:
            p = 2.0 * math.pi / math.atan(im / re) if math.atan(im / re) != 0.0 else period
        p = min(max(p, 0.67 * period), 1.5 * period) if period else p
        period = 0.2 * min(max(p, 6.0), 50.0) + 0.8 * period
        new = math.degrees(math.atan(q1 / i1)) if i1 != 0.0 else 0.0
        alpha = min(max(_FAST / max(phase - new, 1.0), _SLOW), _FAST)
        phase = new
        mama = v if mama is None else alpha * v + (1.0 - alpha) * mama
        out.append(mama)
        states.append([*price, *smooth, *det, *i1s, *q1s, i2, q2, re, im, period, phase, mama])
    return out, states


KERNELS: dict[str, Callable] = {"MGD": mcginley, "MAMA": mesa, "AHMA": ahrens}


def recursive(df: DataFrame, src: str, out: str, kernel: Callable, n: int, first: int = 0, layout: Layout = BARS,
              warm: int | None = None, tolerance: float = 1e-11) -> DataFrame:
    """Nonlinear recursion over each series, started on row ``first``.  Runs jobs to verify chunk boundaries."""
    key = list(layout.key)
    warm = 40 * max(n, 8) if warm is None else warm
    warm = min(warm, layout.rows * 4)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    base = settle(index_rows(df, layout))
    rows, size = F.lit(layout.rows), layout.rows
    slim = base.where(F.col("_i") >= first).select(*key, "_i", F.col(src).cast("double").alias("_x"))
    schema = f"{types}, _chunk bigint, _i bigint, _y double, _start array<double>, _end array<double>"

    def chunk_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        chunk = int(pdf["_chunk"].iloc[0])
        lo = max(chunk * size, first)
        idx, x = pdf["_i"].to_numpy(), pdf["_x"].to_numpy(float)
        seed = pdf["_seed"].iloc[0]
        seed = None if seed is None or (isinstance(seed, float) and math.isnan(seed)) else [float(v) for v in seed]
        core = idx >= lo
        if seed is not None:
            idx, x, core = idx[core], x[core], core[core]
        ys, states = kernel(x, n, seed)
        keep = np.flatnonzero(core)
        if not len(keep):
            return pd.DataFrame(columns=[*key, "_chunk", "_i", "_y", "_start", "_end"])
        start = seed if seed is not None else (states[keep[0] - 1] if keep[0] > 0 else None)
        blank = [None] * len(keep)
        starts, ends = list(blank), list(blank)
        starts[0], ends[-1] = start, states[keep[-1]]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, "_chunk": chunk, "_i": idx[keep],
                             "_y": np.array(ys)[keep], "_start": starts, "_end": ends})

    no_seed = F.lit(None).cast("array<double>").alias("_seed")
    spread = slim.select("*", no_seed, F.explode(F.sequence(F.floor(F.col("_i") / rows),
                                                            F.floor((F.col("_i") + F.lit(warm)) / rows))).alias("_chunk"))
    own = slim.withColumn("_chunk", F.floor(F.col("_i") / rows))
    done = settle(spread.groupBy(*key, "_chunk").applyInPandas(chunk_run, schema))
    while True:
        ends = done.where(F.col("_end").isNotNull()).select(*key, (F.col("_chunk") + 1).alias("_chunk"), F.col("_end").alias("_seed"))
        starts = done.where(F.col("_start").isNotNull()).select(*key, "_chunk", "_start")
        gap = F.array_max(F.zip_with("_seed", "_start", lambda p, q: F.abs(p - q) / (F.abs(p) + 1.0)))
        wrong = F.coalesce(gap > tolerance, F.lit(True)) | (F.size("_seed") != F.size("_start"))
        bad = ends.join(starts, [*key, "_chunk"]).where(wrong).select(*key, "_chunk", "_seed")
        if bad.isEmpty():
            break
        again = (own.join(bad, [*key, "_chunk"]).groupBy(*key, "_chunk").applyInPandas(chunk_run, schema))
        done = settle(done.join(bad.select(*key, "_chunk"), [*key, "_chunk"], "left_anti").unionByName(again))
    return base.drop(out).join(done.select(*key, "_i", F.col("_y").alias(out)), [*key, "_i"], "left")

