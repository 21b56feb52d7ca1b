"""Price sources and the moving-average registry.

An ``Averages`` object collects requests, shares equal sub-results, and builds
them level by level: all bounded averages of a level in one halo pass, all
constant-decay averages in one block-scan pass.  Warm-up is NULL: an average of
``n`` rows starts on the ``n``-th row of its input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import EPS, non_negative, total
from barloom.operators.ordered import BARS, Layout, decayed, framed, index_rows, rolling_sums, settle
from barloom.operators.recursions import affine, recursive, KERNELS

PRICE_SOURCES = ("open", "high", "low", "close", "hl2", "hlc3", "ohlc4", "hlcc4")


def price_source(name: str, df: DataFrame | None = None) -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    known = {"open": o, "high": h, "low": lo, "close": c, "hl2": (h + lo) * 0.5, "hlc3": (h + lo + c) / 3.0,
             "ohlc4": (o + h + lo + c) / 4.0, "hlcc4": (h + lo + c * 2.0) / 4.0}
    if name in known:
        return known[name]
    if name == "vwap" and df is not None and "vwap" in df.columns:
        return F.col("vwap")
    raise ValueError(f"unknown price source: {name}")


# ---- fixed weights, oldest to newest ---------------------------------------------------------

def kernel_weights(kernel: str, n: int) -> np.ndarray:
    u = np.arange(n - 1, -1, -1, dtype=float) / n
    shape = {
        "gauss": np.exp(-0.5 * u * u), "epan": 1.0 - u * u, "unif": np.ones(n), "tria": 1.0 - u,
        "biw": (1.0 - u * u) ** 2, "cos": np.cos(np.pi / 2.0 * u),
    }[kernel]
    return shape / shape.sum()


def alma_weights(n: int, offset: float = 0.85, sigma: float = 6.0) -> np.ndarray:
    w = np.exp(-((np.arange(n) - offset * (n - 1)) ** 2) / (2.0 * (n / sigma) ** 2))
    return w / w.sum()


def hamming_weights(n: int) -> np.ndarray:
    w = np.hamming(n)
    return w / w.sum()


def triangle_weights(n: int, inverted: bool = False) -> np.ndarray:
    i = np.arange(n, dtype=float)
    w = np.minimum(i, n - 1 - i) + 1.0
    if inverted:
        w = w.max() + 1.0 - w
    return w / w.sum()


def fibonacci_weights(n: int) -> np.ndarray:
    f = [1.0, 2.0]
    while len(f) < n + 1:
        f.append(f[-1] + f[-2])
    w = (np.array(f) - f[0])[1:n + 1]
    return w / w.sum()


def sharp_weights(n: int) -> np.ndarray:
    age = np.arange(n - 1, -1, -1, dtype=float)
    return 1.0 / n + 6.0 * (n - (2.0 * age + 1.0)) / 2.0 / ((n + 1.0) * n)


def fibonacci_periods(n: int) -> list[int]:
    out, a, b = [], 1, 2
    while b <= n:
        out.append(b)
        a, b = b, a + b
    return out


FIR = {"ALMA": alma_weights, "HAMMING": hamming_weights, "SWMA": triangle_weights,
       "SWMA_INV": lambda n: triangle_weights(n, True), "FWMA": fibonacci_weights, "SHMMA": sharp_weights,
       **{f"NWMA_{k.upper()}": (lambda n, k=k: kernel_weights(k, n)) for k in ("gauss", "epan", "unif", "tria", "biw", "cos")}}
DECAY_ALPHA = {"EMA": lambda n: 2.0 / (n + 1.0), "RMA": lambda n: 1.0 / n}
COMPOSED = ("HMA", "TRIMA", "DEMA", "TEMA", "T3", "FBA", "LMA", "EHMA")
FINITE = ("SMA", "WMA", "LWMA", "LINREG", "LSMA", "VWMA", "VWMA_PTA", "GMA", "STD", "MIN", "MAX", *FIR)
RECURSIVE = ("KAMA", "VIDYA", "MGD", "MAMA", "AHMA")
_ALIAS = {"LWMA": "WMA", "LSMA": "LINREG", "VWMA_PTA": "VWMA"}


def kind_of(ma: str) -> str:
    """``finite``, ``decay``, ``composed`` or ``recursive``."""
    for kind, names in (("finite", FINITE), ("decay", DECAY_ALPHA), ("composed", COMPOSED), ("recursive", RECURSIVE)):
        if ma in names:
            return kind
    raise ValueError(f"unknown moving average: {ma}")


@dataclass
class _Node:
    kind: str
    ma: str = ""
    src: str = ""
    n: int = 0
    lead: int = 0
    level: int = 0
    expr: Column | None = None
    weights: tuple = ()


@dataclass
class Averages:
    """Requests for averages over one indexed frame."""

    df: DataFrame
    layout: Layout = BARS
    volume: str = "volume"
    leads: dict[str, int] = field(default_factory=dict)
    nodes: dict[str, _Node] = field(default_factory=dict)

    def _lead(self, c: str) -> tuple[int, int]:
        if c in self.nodes:
            return self.nodes[c].lead, self.nodes[c].level
        return self.leads.get(c, 0), 0

    def expression(self, name: str, expr: Column, inputs: list[str], extra_lead: int = 0) -> str:
        lead, level = (max(x) for x in zip(*[self._lead(c) for c in inputs]))
        self.nodes[name] = _Node("expr", lead=lead + extra_lead, level=level, expr=expr)
        return name

    def want(self, ma: str, src: str, n: int) -> str:
        """Column name that will hold the average; equal requests share one column."""
        ma, n = _ALIAS.get(ma, ma), int(n)
        name = f"_{ma}_{n}_{src}".replace("__", "_")
        if name in self.nodes:
            return name
        lead, level = self._lead(src)
        kind = kind_of(ma)
        if kind == "composed":
            return self._composed(ma, src, n, name)
        warm = {"KAMA": n, "MAMA": 32, "AHMA": n - 1, "MGD": n - 1, "VIDYA": n}.get(ma, n - 1)
        self.nodes[name] = _Node(kind, ma, src, n, lead + warm, level + 1)
        return name

    def weighted(self, name: str, src: str, weights) -> str:
        """Trailing average with custom weights, oldest first."""
        w = np.asarray(weights, float)
        lead, level = self._lead(src)
        self.nodes[name] = _Node("finite", "CUSTOM", src, len(w), lead + len(w) - 1, level + 1, weights=tuple(w / w.sum()))
        return name

    def _composed(self, ma: str, src: str, n: int, name: str) -> str:
        if ma == "HMA":
            n = max(n, 4)
            half, full = self.want("WMA", src, n // 2), self.want("WMA", src, n)
            raw = self.expression(f"{name}_raw", F.col(half) * 2.0 - F.col(full), [half, full])
            return self._rename(name, self.want("WMA", raw, int(math.sqrt(n))))
        if ma == "EHMA":
            half, full = self.want("EMA", src, max(n // 2, 1)), self.want("EMA", src, n)
            raw = self.expression(f"{name}_raw", F.col(half) * 2.0 - F.col(full), [half, full])
            return self._rename(name, self.want("EMA", raw, max(int(math.sqrt(n)), 1)))
        if ma == "TRIMA":
            a, b = ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)
            return self._rename(name, self.want("SMA", self.want("SMA", src, a), b))
        if ma == "LMA":
            w, s = self.want("WMA", src, n), self.want("SMA", src, n)
            return self.expression(name, F.col(w) * 2.0 - F.col(s), [w, s])
        if ma == "FBA":
            parts = [self.want("EMA", src, p) for p in fibonacci_periods(n)]
            return self.expression(name, total([F.col(p) for p in parts]) / float(len(parts)), parts)
        chain = [src]
        for _ in range({"DEMA": 2, "TEMA": 3, "T3": 6}[ma]):
            chain.append(self.want("EMA", chain[-1], n))
        e = [F.col(c) for c in chain]
        if ma == "DEMA":
            return self.expression(name, e[1] * 2.0 - e[2], chain[1:])
        if ma == "TEMA":
            return self.expression(name, e[1] * 3.0 - e[2] * 3.0 + e[3], chain[1:])
        v = 0.7  # fixed volume factor
        return self.expression(name, e[6] * -v ** 3 + e[5] * (3 * v ** 2 + 3 * v ** 3)
                               + e[4] * (-6 * v ** 2 - 3 * v - 3 * v ** 3) + e[3] * (1 + 3 * v + v ** 3 + 3 * v ** 2), chain[3:])

    def _rename(self, name: str, inner: str) -> str:
        return self.expression(name, F.col(inner), [inner])

    # ---- building -----------------------------------------------------------------------------

    def build(self) -> DataFrame:
        df = index_rows(self.df, self.layout)
        deepest = max((n.level for n in self.nodes.values()), default=0)
        for level in range(0, deepest + 1):
            if level and deepest > 1:               # a level reads its input twice; unsettled, reads would double with each
                df = settle(df)
            todo = {k: n for k, n in self.nodes.items() if n.level == level}
            finite = {k: n for k, n in todo.items() if n.kind == "finite"}
            decay = {k: n for k, n in todo.items() if n.kind == "decay"}
            if finite:
                df = self._finite(df, finite)
            if decay:
                df = self._decay(df, decay)
            for k, n in todo.items():
                if n.kind == "recursive":
                    df = self._recursive(df, k, n)
            for k, n in todo.items():  # requests are listed inputs first
                if n.kind == "expr":
                    df = df.withColumn(k, n.expr)
        return df

    def _gate(self, value: Column, lead: int) -> Column:
        return F.when(F.col("_i") >= lead, value)

    def _finite(self, df: DataFrame, nodes: dict[str, _Node]) -> DataFrame:
        volume = F.col(self.volume)
        back = max(n.n for n in nodes.values())
        sources = list(dict.fromkeys(n.src for n in nodes.values()))
        positive = {n.src for n in nodes.values() if n.ma == "GMA"}
        if positive:  # the log form applies only when the whole series is positive
            lows = df.groupBy(*self.layout.key).agg(*[F.min(s).alias(f"_min_{s}") for s in positive])
            df = df.join(lows, list(self.layout.key))

        def build(f, w):
            step = F.col("_i") - F.col("_chunk") * F.lit(self.layout.rows)
            sums: dict[str, tuple[Column, int]] = {}
            plain, out = {}, {}
            # Levels cancel badly in long sums and squares: sums run on values less their chunk's mean.
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            f = f.select("*", *[F.avg(s).over(whole).alias(f"_mu_{s}") for s in sources])
            for k, n in nodes.items():
                value, mu, m = F.col(n.src), F.col(f"_mu_{n.src}"), n.n
                x = value - mu
                if n.ma in FIR or n.ma == "CUSTOM":
                    ws = n.weights or tuple(FIR[n.ma](m))
                    window = F.collect_list(value).over(w.rowsBetween(-(m - 1), 0))
                    plain[f"_w_{k}"] = F.when(F.size(window) == m, window)
                    dot = F.aggregate(F.zip_with(F.col(f"_w_{k}"), F.array(*[F.lit(float(v)) for v in ws]), lambda a, b: a * b),
                                      F.lit(0.0), lambda acc, v: acc + v)
                    out[k] = dot
                elif n.ma in ("MIN", "MAX"):
                    frame = w.rowsBetween(-(m - 1), 0)
                    edge = (F.min if n.ma == "MIN" else F.max)(value).over(frame)
                    plain[f"_w_{k}"] = F.when(F.count(value).over(frame) == m, edge)
                    out[k] = F.col(f"_w_{k}")
                else:
                    sums[f"_s_{n.src}_{m}"] = (x, m)
                    s = F.col(f"_s_{n.src}_{m}")
                    if n.ma == "SMA":
                        out[k] = mu + s / m
                    elif n.ma in ("WMA", "LINREG"):
                        sums[f"_x_{n.src}_{m}"] = (x * step, m)
                        # weight of a row is its age counted from the window's oldest row
                        ramp = F.col(f"_x_{n.src}_{m}") - (step - (m - 1)) * s
                        if n.ma == "WMA":
                            out[k] = mu + (ramp + s) * (2.0 / (m * (m + 1.0)))
                        else:
                            slope = (ramp - s * ((m - 1) / 2.0)) * (12.0 / (m * (m * m - 1.0)))
                            out[k] = mu + s / m + slope * ((m - 1) / 2.0)
                    elif n.ma == "VWMA":
                        sums[f"_v_{m}"] = (volume, m)
                        sums[f"_xv_{n.src}_{m}"] = (x * volume, m)
                        out[k] = F.when(F.col(f"_v_{m}") > EPS, mu + F.col(f"_xv_{n.src}_{m}") / F.col(f"_v_{m}"))
                    elif n.ma == "GMA":
                        sums[f"_ln_{n.src}_{m}"] = (F.when(value.isNotNull(), F.ln(F.greatest(F.abs(value), F.lit(EPS)))), m)
                        out[k] = F.when(F.col(f"_min_{n.src}") <= 0, mu + s / m).otherwise(F.exp(F.col(f"_ln_{n.src}_{m}") / m))
                    elif n.ma == "STD":
                        sums[f"_q_{n.src}_{m}"] = (x * x, m)
                        out[k] = F.sqrt(non_negative(F.col(f"_q_{n.src}_{m}") / m - (s / m) * (s / m)))
            f = f.select("*", *[c.alias(a) for a, c in plain.items()])
            f = rolling_sums(f, w, sums)
            f = f.select("*", *[self._gate(c, nodes[k].lead).alias(k) for k, c in out.items()])
            return f.drop(*plain, *sums, *[f"_mu_{s}" for s in sources])

        return framed(df, build, self.layout, back=back).drop(*[f"_min_{s}" for s in positive])

    def _decay(self, df: DataFrame, nodes: dict[str, _Node]) -> DataFrame:
        specs = {}
        for k, n in nodes.items():
            a = DECAY_ALPHA[n.ma](n.n)
            x, i = F.col(n.src), F.col("_i")
            if a >= 1.0:
                df = df.withColumn(k, x)
                continue
            start, seed = n.lead - n.n + 1, n.lead
            # The seed is the mean of the first n rows, written as decayed contributions of those rows.
            early = x / n.n * F.exp(F.lit(math.log(1.0 - a)) * (i - seed).cast("double"))
            specs[k] = (F.when(i < start, 0.0).when(i <= seed, early).otherwise(x * a), 1.0 - a)
        df = decayed(df, specs, self.layout) if specs else df
        return df.withColumns({k: self._gate(F.col(k), n.lead) for k, n in nodes.items()})

    def _recursive(self, df: DataFrame, k: str, n: _Node) -> DataFrame:
        start = n.lead - {"KAMA": n.n, "VIDYA": n.n}.get(n.ma, 0)
        x = F.col(n.src)
        if n.ma in ("KAMA", "VIDYA"):
            def build(f, w):
                f = f.withColumn("_d", x - F.lag(x, 1).over(w))
                span = w.rowsBetween(-(n.n - 1), 0)
                up, down = F.sum(F.greatest(F.col("_d"), F.lit(0.0))).over(span), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(span)
                return f.select("*", up.alias("_up"), down.alias("_dn"), F.lag(x, n.n).over(w).alias("_far")).drop("_d")

            df = framed(df, build, self.layout, back=n.n + 1)
            path = F.col("_up") + F.col("_dn")
            if n.ma == "KAMA":
                er = F.when((path <= F.abs(x - F.col("_far"))) | (path < 1e-14), 1.0).otherwise(F.abs(x - F.col("_far")) / path)
                alpha = F.pow(er * (2.0 / 3.0 - 2.0 / 31.0) + 2.0 / 31.0, F.lit(2.0))
            else:
                alpha = F.when(path < 1e-14, 0.0).otherwise(F.abs(F.col("_up") - F.col("_dn")) / path) * (2.0 / (n.n + 1.0))
            seed_row = start + n.n - 1
            i = F.col("_i")
            a = F.when(i <= seed_row, 0.0).otherwise(1.0 - alpha)
            b = F.when(i < seed_row, 0.0).when(i == seed_row, x).otherwise(alpha * x)
            df = affine(df.withColumns({"_a": a, "_b": b}), "_a", "_b", k, self.layout).drop("_a", "_b", "_up", "_dn", "_far")
        else:
            first = self._lead(n.src)[0]
            df = recursive(df, n.src, k, KERNELS[n.ma], n.n, first, self.layout)
        return df.withColumn(k, self._gate(F.col(k), n.lead))


def apply_averages(df: DataFrame, wanted: dict[str, tuple[str, str, int]], layout: Layout = BARS) -> DataFrame:
    """``out -> (type, source column, period)``; adds the outputs to ``df``."""
    av = Averages(df, layout)
    names = {out: av.want(ma, src, n) for out, (ma, src, n) in wanted.items()}
    built = av.build()
    return built.select(*df.columns, *[F.col(v).alias(k) for k, v in names.items()])
