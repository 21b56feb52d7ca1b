"""Decayed price profiles (volume and support/resistance) and the features read from them.

The mass of a price bin decays with every step, so a profile is one constant-decay
recursion per bin.  Steps are cut into chunks: chunk totals per bin are summed
map-side, the block scan of ``ordered.decayed`` carries them over chunks, and
each chunk's task replays its own rows, a block at a time, on top of the carries
of the bins it can read.  No task sees more than one chunk of steps and one chunk of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import quotient
from barloom.operators.ordered import BARS, Layout, decayed, index_rows, running, settle

HALF_LIVES = {"short": 1440, "medium": 10080, "long": 43200, "all": None}
_SCALE_MIN = 1e-3
_SCALE_ROOM = 230.0                 # scales up to e^230 inside a block of rows
BLOCK_ROWS = 128                    # rows that are replayed at once
_GONE = 1e-130  # a chunk decay this small leaves nothing of the carry in a double


def decay_of(half_life) -> float:
    return 1.0 if half_life is None else 0.5 ** (1.0 / float(half_life))


@dataclass(frozen=True)
class VolumeProfile:
    price_min: float = 1.0
    price_max: float = 200_000.0
    step: float = 5.0
    sigma_divisor: float = 6.0
    min_sigma: float = 1e-9
    neighbors: int = 2
    local_window: int = 64
    eps: float = 1e-6
    half_lives: dict = field(default_factory=lambda: dict(HALF_LIVES))

    @property
    def bins(self) -> int:
        return max(1, math.ceil((self.price_max - self.price_min) / self.step))


@dataclass(frozen=True)
class ReactionProfile:
    price_min: float = 0.0
    price_max: float = 2_000_000.0
    step: float = 5.0
    neighbors: float = 3.0
    local_window: int = 64
    eps: float = 1e-12
    min_strength: float = 0.0
    wick_power: float = 1.0
    distance_power: float = 1.0
    positive_only: bool = True          # prices that are not positive react with strength 0, else by the limits of the logarithm
    half_lives: dict = field(default_factory=lambda: {"short": 60, "medium": 3600, "long": 20_000, "all": None})

    @property
    def bins(self) -> int:
        return max(1, math.ceil((self.price_max - self.price_min) / self.step))


# ---- contributions of one candle -------------------------------------------------------------

_MASS = "array<struct<kind:int,bin:int,mass:double>>"


# Coefficients of rational approximations to the error function (W. J. Cody, 1969), highest power first.
_ERF_SMALL = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
              (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_ERF_MIDDLE = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
                8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
               (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
                3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
_ERF_LARGE = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
              (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))
_ERF_ONE = 6.0                      # from here on the error function is 1 in a double


def erf(x: Column) -> Column:
    """Error function as a column, right to the last digits of a double."""
    def ratio(z: Column, parts) -> Column:
        over, under = (reduce(lambda acc, c: acc * z + F.lit(c), p[1:], F.lit(p[0])) for p in parts)
        return over / under

    y = F.abs(x)
    middle = 1.0 - F.exp(-y * y) * ratio(y, _ERF_MIDDLE)
    z = 1.0 / (y * y)
    large = 1.0 - F.exp(-y * y) / y * (F.lit(1.0 / math.sqrt(math.pi)) - z * ratio(z, _ERF_LARGE))
    upper = F.when(y <= 4.0, middle).when(y < _ERF_ONE, large).otherwise(1.0)
    return F.when(y <= 0.46875, x * ratio(x * x, _ERF_SMALL)).otherwise(F.signum(x) * upper)


def _inside(price: Column, cfg) -> Column:
    """Bin of a price, the nearest one for prices outside the range."""
    return F.least(F.greatest(F.floor((price - cfg.price_min) / cfg.step), F.lit(0)), F.lit(cfg.bins - 1)).cast("int")


def volume_mass(cfg: VolumeProfile) -> Column:
    """Candle volume spread over price bins by normal probability between low and high; none for rows without volume.

    The probability is taken once at each bin edge inside the candle; a candle without height gives all to one bin.
    """
    h, lo, v = F.col("high"), F.col("low"), F.col("volume")
    mid = 0.5 * (h + lo)
    sd = F.greatest((h - lo) / cfg.sigma_divisor, F.lit(cfg.min_sigma)) * math.sqrt(2.0)
    first = _inside(lo, cfg)
    edges = F.transform(F.sequence(first, F.greatest(_inside(h, cfg), first) + 1), lambda k: (
        F.least(F.greatest(F.lit(cfg.price_min) + k * cfg.step, lo), h) - mid) / sd)
    edges = F.transform(edges, lambda x: 0.5 * erf(x))              # one name for what the formula repeats

    def between(at: Column) -> Column:
        return F.transform(F.slice(at, 2, F.size(at) - 1), lambda e, i: F.struct((first + i).alias("bin"), (e - F.get(at, i)).alias("w")))

    parts = F.get(F.transform(F.array(edges), between), 0)          # bound to a name, so edges are computed once

    def row(bin_: Column, mass: Column) -> Column:
        return F.struct(F.lit(0).alias("kind"), bin_.alias("bin"), mass.alias("mass"))

    def shared(found: Column) -> Column:
        total = F.array(F.aggregate(found, F.lit(0.0), lambda acc, p: acc + p["w"]))
        return F.get(F.transform(total, lambda t: F.when(t > 0, F.transform(F.filter(found, lambda p: p["w"] > 0), lambda p: row(p["bin"], v * p["w"] / t)))), 0)

    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    spread = F.get(F.transform(F.array(F.when(h - lo > 1e-12, parts)), shared), 0)
    some = F.coalesce(spread, F.array(row(_inside(mid, cfg), v)))
    return F.when(finite(h) & finite(lo) & finite(v) & (v != 0), some).otherwise(F.array()).cast(_MASS)


def volume_steps(bars: DataFrame, cfg: VolumeProfile) -> DataFrame:
    """Decay advances only on rows with a valid non-zero volume."""
    valid = F.coalesce((F.col("volume") != 0) & ~F.isnan("volume") & F.col("high").isNotNull() & F.col("low").isNotNull(), F.lit(False))
    return bars.withColumn("_m", volume_mass(cfg)).withColumn("_valid", valid)


def reaction_strengths(cfg: ReactionProfile) -> dict[str, Column]:
    """Support and resistance of a candle; without ``positive_only`` a price of zero makes them infinite, or NaN without a wick."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    ok = rng > cfg.eps
    if cfg.positive_only:
        ok = ok & (lo > 0) & (h > 0) & (c > 0)

    def strength(wick, move):
        s = F.pow(F.greatest(wick, F.lit(0.0)) / rng, F.lit(cfg.wick_power)) * F.greatest(move, F.lit(0.0))
        return F.when(ok & (s >= cfg.min_strength), s).otherwise(0.0)

    return {"support": strength(F.least(o, c) - lo, F.ln(quotient(c, lo))), "resistance": strength(h - F.greatest(o, c), F.ln(quotient(h, c)))}


def price_bin(price, cfg) -> Column:
    p = F.col(price) if isinstance(price, str) else price
    b = F.floor((p - cfg.price_min) / cfg.step).cast("int")
    return F.when((p >= cfg.price_min) & (p <= cfg.price_max) & (b >= 0) & (b < cfg.bins), b)


def reaction_mass(cfg: ReactionProfile) -> Column:
    """Triangular spread of each reaction over its neighbour bins; kind 0 support, 1 resistance."""
    s = reaction_strengths(cfg)
    radius = math.ceil(cfg.neighbors)

    def kernel(kind, center, strength):
        offs = F.sequence(F.lit(-radius), F.lit(radius))
        w = (lambda k: F.greatest(1.0 - F.abs(k) / F.lit(cfg.neighbors), F.lit(0.0))) if cfg.neighbors > cfg.eps else (
            lambda k: (k == 0).cast("double"))
        rows = F.transform(offs, lambda k: F.struct(F.lit(kind).alias("kind"), (center + k).cast("int").alias("bin"), (strength * w(k)).alias("mass")))
        live = F.filter(rows, lambda r: (r["mass"] > 0) & (r["bin"] >= 0) & (r["bin"] < cfg.bins))
        return F.coalesce(live, F.array().cast(_MASS))

    return F.concat(kernel(0, price_bin("low", cfg), s["support"]), kernel(1, price_bin("high", cfg), s["resistance"]))


def reaction_steps(bars: DataFrame, cfg: ReactionProfile) -> DataFrame:
    """Decay advances on every row."""
    return bars.withColumn("_m", reaction_mass(cfg)).withColumn("_valid", F.lit(True))


# ---- snapshot ---------------------------------------------------------------------------------

def snapshot(steps: DataFrame, half_lives: dict, layout: Layout = BARS, at=None) -> DataFrame:
    """Profile at time ``at`` (default: the last row): one aggregate over all contributions."""
    if at is not None:
        steps = steps.where(F.col(layout.time) <= F.lit(at).cast("timestamp"))
    counted = running(steps, layout, _s=("sum", F.col("_valid").cast("bigint")))
    total = steps.groupBy(*layout.key).agg(F.sum(F.col("_valid").cast("bigint")).alias("_n"))
    rows = counted.join(total, list(layout.key)).select(*layout.key, "_n", "_s", F.inline("_m"))
    age = (F.col("_n") - F.col("_s")).cast("double")
    wide = rows.groupBy(*layout.key, "kind", "bin").agg(*[
        F.sum(F.col("mass") * F.exp(F.lit(math.log(decay_of(h))) * age)).alias(name) for name, h in half_lives.items()])
    return wide.unpivot([*layout.key, "kind", "bin"], list(half_lives), "horizon", "mass")


# ---- features per row ---------------------------------------------------------------------------

def _chunk_rows(steps: DataFrame, layout: Layout) -> DataFrame:
    """Rows with step number, chunk of steps, and part; steps of a chunk are repeated for its later parts."""
    base = index_rows(steps, layout)
    base = running(base, layout, _s=("sum", F.col("_valid").cast("bigint")))
    size = F.lit(layout.rows)
    base = settle(base.withColumn("_chunk", F.floor(F.greatest(F.col("_s") - 1, F.lit(0)) / size)))
    bounds = base.groupBy(*layout.key, "_chunk").agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    j = base.join(bounds, [*layout.key, "_chunk"])
    part, top = F.floor((F.col("_i") - F.col("_first")) / size), F.floor((F.col("_last") - F.col("_first")) / size)
    return j.withColumn("_home", part).withColumn(
        "_part", F.explode(F.when(F.col("_valid"), F.sequence(part, top)).otherwise(F.array(part)))).drop("_first", "_last")


def _carries(rows: DataFrame, half_lives: dict, layout: Layout) -> DataFrame:
    """State of every bin at the start of each chunk, sparse."""
    key = list(layout.key)
    home = rows.where("_home = _part")
    last = home.groupBy(*key).agg(F.max("_chunk").alias("_top"))
    end_age = ((F.col("_chunk") + 1) * layout.rows - F.col("_s")).cast("double")
    endless = F.isnan("mass") | (F.abs("mass") == float("inf"))     # never fades, so it is summed up apart
    totals = home.select(*key, "_chunk", end_age.alias("_age"), F.inline("_m")).groupBy(*key, "kind", "bin", "_chunk").agg(*[
        F.sum(F.when(~endless, F.col("mass") * F.exp(F.lit(math.log(decay_of(h))) * F.col("_age")))).alias(n) for n, h in half_lives.items()],
        F.sum(F.when(endless, F.col("mass"))).alias("_endless"))
    grid = totals.select(*key, "kind", "bin").distinct().join(last, key).select(
        *key, "kind", "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"))).alias("_chunk"))
    dense = grid.join(totals, [*key, "kind", "bin", "_chunk"], "left").fillna(0.0, list(half_lives))
    lay = Layout(key=(*key, "kind", "bin"), time="_t", base_seconds=1, rows=layout.rows)
    dense = settle(dense.withColumn("_i", F.col("_chunk")).withColumn("_t", F.timestamp_seconds("_chunk")))
    rates = {f"y_{n}": (F.col(n), max(decay_of(h) ** layout.rows, _GONE)) for n, h in half_lives.items()}
    ends = decayed(dense, {**rates, "_kept": (F.col("_endless"), 1.0)}, lay, max_lags=64)
    return ends.select(*key, "kind", "bin", (F.col("_chunk") + 1).alias("_chunk"), *[
        (F.col(f"y_{n}") + F.coalesce("_kept", F.lit(0.0))).alias(n) for n in half_lives]).where(
        F.greatest(*[F.col(n) for n in half_lives], F.lit(0.0)) > 0)


def masses(carry: np.ndarray, decays: np.ndarray, k: np.ndarray, row: np.ndarray, col: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Mass of every column after every row, ``(horizons, rows, columns)``, from the mass before them and what each row adds.

    ``k`` counts the decay steps up to each row; the recursion is a scaled running sum over the rows.
    """
    n, width = len(k), carry.shape[1]
    out = np.empty((len(decays), n, width))
    for h, a in enumerate(decays):
        added = np.bincount(row * width + col, weights=mass * a ** -k[row], minlength=n * width).astype(float).reshape(n, width)
        added[0] += carry[h]
        out[h] = np.cumsum(added, axis=0) * (a ** k)[:, None]
    return out


def rows_at_once(decays: np.ndarray) -> int:
    """Rows whose scales stay far inside a double."""
    return max(1, min(BLOCK_ROWS, int(_SCALE_ROOM / max(-math.log(min(decays)), 1e-9))))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays, and the row of each."""
    sizes = np.array([0 if v is None else len(v) for v in column], np.int64)
    values = np.concatenate([np.asarray(v) for v in column if v is not None and len(v)]) if sizes.sum() else np.zeros(0)
    return values, np.repeat(np.arange(len(sizes)), sizes)


def window_of(at: np.ndarray, reach: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins within ``reach`` of each row's bin, and which of them exist; none around a negative bin."""
    near = at[:, None] + np.arange(-reach, reach + 1)[None, :]
    return near, (near >= 0) & (near < bins) & (at >= 0)[:, None]


def _replay(steps: DataFrame, half_lives: dict, kinds: int, bins: int, reach: int, at: Column, read: Callable, names: list[str], layout: Layout,
            nan: float | None = None) -> DataFrame:
    """``names`` of every row, read by ``read`` from the masses within ``reach`` bins of the row's bin ``at``; ``nan`` stands for what is NaN.

    A task has one chunk of steps, goes over it in blocks of rows, and gets carries of the bins that the chunk can read.
    """
    key = list(layout.key)
    rows = settle(_chunk_rows(steps.withColumn("_b", F.coalesce(at, F.lit(-1))), layout))
    parts = rows.groupBy(*key, "_chunk", "_part").agg(F.min(F.when(F.col("_b") >= 0, F.col("_b"))).alias("_low"), F.max("_b").alias("_high"))
    carry = _carries(rows, half_lives, layout).join(parts, [*key, "_chunk"]).where(F.col("bin").between(F.col("_low") - reach, F.col("_high") + reach)).drop("_low", "_high")
    horizons, decays = list(half_lives), np.array([decay_of(h) for h in half_lives.values()])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    group, size = [*key, "_chunk", "_part"], rows_at_once(decays)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[*key, "_i", *names])
        mass = np.zeros((kinds, len(horizons), bins))
        if len(right):
            mass[right["kind"].to_numpy(int)[:, None], np.arange(len(horizons))[None, :], right["bin"].to_numpy(int)[:, None]] = right[horizons].to_numpy(float)
        scale, left, out = np.ones(len(horizons)), left.sort_values("_i"), []
        for lo in range(0, len(left), size):
            part = left.iloc[lo:lo + size]
            k, b = np.cumsum(part["_valid"].to_numpy(int)), part["_b"].to_numpy(int)
            (bin_, row), (kind, _), (w, _) = flat(part["_bin"]), flat(part["_kind"]), flat(part["_mass"])
            near, there = window_of(b, reach, bins)
            used = np.unique(np.concatenate([near[there], bin_.astype(np.int64)]))
            where = np.minimum(np.searchsorted(used, np.where(there, near, 0)), max(len(used) - 1, 0))
            seen = np.zeros((kinds, len(horizons), *near.shape))
            for q in range(kinds if len(used) else 0):
                mine = kind == q
                after = masses(mass[q][:, used] * scale[:, None], decays, k, row[mine], np.searchsorted(used, bin_[mine]), w[mine])
                seen[q] = np.where(there[None], np.take_along_axis(after, where[None].repeat(len(horizons), 0), axis=2), 0.0)
                mass[q][:, used] = after[:, -1] / (scale * decays ** k[-1])[:, None]
            scale = scale * decays ** k[-1]
            low = scale < _SCALE_MIN
            mass[:, low] *= scale[low][None, :, None]
            scale[low] = 1.0
            out.append(read(seen, b))
        res = pd.DataFrame(np.concatenate(out), columns=names)
        for c in key:
            res[c] = left[c].iloc[0]
        res["_i"] = left["_i"].to_numpy()
        return res[(left["_home"] == left["_part"]).to_numpy()][[*key, "_i", *names]]

    carry = carry.withColumnsRenamed({c: f"c_{c}" for c in group})  # the two sides share lineage: own names per side
    sent = rows.select(*group, "_i", "_home", "_valid", "_b", *[F.col(f"_m.{c}").alias(f"_{c}") for c in ("kind", "bin", "mass")])
    made = sent.groupBy(*group).cogroup(carry.groupBy(*[f"c_{c}" for c in group])).applyInPandas(
        run, f"{types}, _i bigint, " + ", ".join(f"`{n}` double" for n in names))
    keep = [c for c in steps.columns if c not in ("_m", "_valid")]
    kept = rows.where("_home = _part").select(*dict.fromkeys([*keep, "_i"]))
    found = [F.when(F.isnan(n) | F.isnull(n), F.lit(nan)).otherwise(F.col(n)).alias(n) for n in names]   # NaN may come back from Python as NULL
    return kept.join(made.select(*key, "_i", *found), [*key, "_i"])


def volume_names(cfg: VolumeProfile) -> list[str]:
    shifts = [s for s in range(-cfg.neighbors, cfg.neighbors + 1) if s]
    parts = [f"log_density_ratio_to_current_bin_{'minus' if s < 0 else 'plus'}_{abs(s)}" for s in shifts]
    parts += ["local_above_below_volume_log_ratio", "current_bin_volume_share_of_local_window", "current_bin_volume_share_of_local_peak"]
    return [f"vp_{h}_{part}" for h in cfg.half_lives for part in parts]


def reaction_names(cfg: ReactionProfile) -> list[str]:
    parts = ["support_below", "resistance_above", "support_above", "resistance_below", "imbalance",
             "support_center_distance", "resistance_center_distance"]
    return [f"rp_{h}_{part}" for h in cfg.half_lives for part in parts]


def volume_bin(cfg: VolumeProfile) -> Column:
    return _inside(0.5 * (F.col("high") + F.col("low")), cfg)


def read_volume(cfg: VolumeProfile) -> Callable:
    """Function of the masses around each row ``(kind, horizon, row, offset)`` and the rows' bins."""
    shifts = np.array([s for s in range(-cfg.neighbors, cfg.neighbors + 1) if s])
    reach = max(cfg.local_window, cfg.neighbors)
    far = np.abs(np.arange(-reach, reach + 1)) > cfg.local_window

    def read(seen: np.ndarray, b: np.ndarray) -> np.ndarray:
        v, cur = seen[0], seen[0][:, :, reach]
        at = np.clip(b[:, None] + shifts, 0, cfg.bins - 1) - b[:, None] + reach
        near = np.take_along_axis(v, np.clip(at, 0, 2 * reach)[None].repeat(len(v), 0), axis=2)
        local = np.where(far, 0.0, v)
        below, above = local[:, :, :reach].sum(2), local[:, :, reach + 1:].sum(2)
        tail = [np.log((above + cfg.eps) / (below + cfg.eps)), cur / (local.sum(2) + cfg.eps), cur / (local.max(2) + cfg.eps)]
        out = np.concatenate([np.log((near + cfg.eps) / (cur + cfg.eps)[:, :, None]), np.stack(tail, 2)], 2)
        out[:, b < 0] = np.nan
        return out.transpose(1, 0, 2).reshape(len(b), -1)

    return read


def volume_profile_features(bars: DataFrame, cfg: VolumeProfile, layout: Layout = BARS) -> DataFrame:
    """Log density ratios to the current bin, local above/below ratio, and shares of local window and peak; NULL without high and low."""
    return _replay(volume_steps(bars, cfg), cfg.half_lives, 1, cfg.bins, max(cfg.local_window, cfg.neighbors), volume_bin(cfg), read_volume(cfg), volume_names(cfg), layout)


_SIDES = ["support_below", "resistance_above", "support_above", "resistance_below", "_sn", "_rn"]


def read_reactions(cfg: ReactionProfile) -> Callable:
    """Function of the masses around each row ``(kind, horizon, row, offset)`` and the rows' bins: ``_SIDES`` of every horizon."""
    offset = np.arange(-cfg.local_window, cfg.local_window + 1)
    dist = np.abs(offset).astype(float)
    weight = 1.0 / (1.0 + dist) ** cfg.distance_power

    def read(seen: np.ndarray, b: np.ndarray) -> np.ndarray:
        def side(kind, which):
            v = np.where(which, seen[kind] * weight, 0.0)
            return v.sum(2), (v * dist).sum(2)

        (sb, sbn), (sa, _), (rb, _), (ra, ran) = side(0, offset < 0), side(0, offset > 0), side(1, offset < 0), side(1, offset > 0)
        return np.stack([sb, ra, sa, rb, sbn, ran], 2).transpose(1, 0, 2).reshape(len(b), -1)

    return read


def reaction_profile_features(bars: DataFrame, cfg: ReactionProfile, layout: Layout = BARS) -> DataFrame:
    """Distance-weighted support and resistance on both sides, their imbalance, and two centre distances.

    An infinite mass stays infinite in its bin on every horizon, however old it is.
    """
    names = [f"rp_{h}_{part}" for h in cfg.half_lives for part in _SIDES]
    rows = _replay(reaction_steps(bars, cfg), cfg.half_lives, 2, cfg.bins, cfg.local_window, price_bin("close", cfg), read_reactions(cfg), names, layout, math.nan)
    made = []
    for h in cfg.half_lives:
        sb, ra, sa, rb, sn, rn = (F.col(f"rp_{h}_{part}") for part in _SIDES)
        made += [sb, ra, sa, rb, sb + rb - ra - sa, F.when(sb > 0, sn / sb), F.when(ra > 0, rn / ra)]
    return rows.select(*[c for c in rows.columns if c not in names], *[c.alias(n) for c, n in zip(made, reaction_names(cfg))])


def reaction_snapshot_features(bars: DataFrame, cfg: ReactionProfile, layout: Layout = BARS, beyond: bool = False) -> DataFrame:
    """The same features for the last row only, by a band join of the snapshot around its bin.

    A last price outside the bins reads none of them, or with ``beyond`` those within its reach.
    """
    snap = snapshot(reaction_steps(bars, cfg), cfg.half_lives, layout)
    last = bars.groupBy(*layout.key).agg(F.max_by("close", layout.time).alias("close"))
    here = last.withColumn("_b", F.floor((F.col("close") - cfg.price_min) / cfg.step) if beyond else price_bin("close", cfg))
    d = here.join(snap, list(layout.key)).withColumn("_d", F.col("bin") - F.col("_b"))
    d = d.where((F.abs("_d") <= cfg.local_window) & (F.col("_d") != 0))
    w = F.col("mass") / F.pow(1.0 + F.abs("_d"), F.lit(cfg.distance_power))

    def pick(kind, cond, extra=F.lit(1.0)):
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & cond, w * extra)), F.lit(0.0))

    below, above = F.col("_d") < 0, F.col("_d") > 0
    a = d.groupBy(*layout.key, "horizon").agg(
        pick(0, below).alias("support_below"), pick(1, above).alias("resistance_above"), pick(0, above).alias("support_above"),
        pick(1, below).alias("resistance_below"), pick(0, below, F.abs("_d")).alias("_sn"), pick(1, above, F.abs("_d")).alias("_rn"))
    return a.withColumns({
        "imbalance": F.col("support_below") + F.col("resistance_below") - F.col("resistance_above") - F.col("support_above"),
        "support_center_distance": F.when(F.col("support_below") > 0, F.col("_sn") / F.col("support_below")),
        "resistance_center_distance": F.when(F.col("resistance_above") > 0, F.col("_rn") / F.col("resistance_above"))}).drop("_sn", "_rn")


def validate_profile_features(names: list[str], expected: list[str], saved_signature: str | None = None, signature: str | None = None) -> None:
    """Feature list and configuration of a saved artefact must match the ones in use."""
    missing = [n for n in names if n not in expected]
    if missing:
        raise ValueError(f"profile features not produced by this configuration: {missing}")
    if saved_signature is not None and saved_signature != signature:
        raise ValueError("profile configuration differs from the saved one")
