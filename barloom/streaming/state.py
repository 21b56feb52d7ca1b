"""Keyed stream state on ``transformWithState``: rows in time order, ring buffers, lazily decayed profiles, expiry.

A micro-batch reaches a key in Arrow slices of any order.  Each slice is put away in map state by span of time, a timer is
set for the newest row of the span, and timers fire in order of time once the batch's rows have been put away.
So a task holds one slice, then one span, however many rows a symbol brings, and works on arrays, not on single rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from barloom.operators.profiles import (ReactionProfile, VolumeProfile, decay_of, flat, masses, price_bin, reaction_mass, read_reactions, read_volume,
                                        rows_at_once, volume_bin, volume_mass, volume_names, window_of)

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPAN_ROWS = 256                     # rows of a span at the base interval
RANGE_BINS = 16                     # bins of a profile that are one entry of the state
SWEEP = 4096                        # steps after which faded entries are looked for


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``advance`` in time order, a span of ``span_seconds`` at a time.

    Columns are ``us`` (microseconds) and what the subclass reads.  Rows of one time stay in the order in which they came.
    Rows whose time lies ahead of the clock wait until then.  With ``idle_seconds`` all state of a key that
    long without rows is gone.
    """

    def __init__(self, span_seconds: int, idle_seconds: float | None = None):
        self.width, self.ttl = span_seconds * 1_000_000, None if idle_seconds is None else int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "span bigint", "slices array<binary>", self.ttl)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the subclass."""

    def advance(self, key, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Output of one span's rows in time order; None where all of them come too late."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for span, part in frame.groupby(frame["us"] // self.width):
                at = (int(span),)
                before = list(self.pending.getValue(at)[0]) if self.pending.containsKey(at) else []
                sink = pa.BufferOutputStream()
                table = pa.Table.from_pandas(part, preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                self.pending.updateValue(at, ([*before, sink.getvalue().to_pybytes()],))
                self.handle.registerTimer(int(part["us"].max()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.width,)
        if self.pending.containsKey(at):
            slices = [pa.ipc.open_stream(bytes(s)).read_pandas() for s in self.pending.getValue(at)[0]]
            self.pending.removeKey(at)
            rows = pd.concat(slices).sort_values("us", kind="stable", ignore_index=True)
            made = self.advance(key, rows)
            if made is not None:
                yield made

    def close(self) -> None:
        pass


def run_in_order(df: DataFrame, processor: InOrder, out: str, initial: DataFrame | None = None) -> DataFrame:
    """``df`` (``symbol, us`` and more) through the processor; the state lives in RocksDB, so it may outgrow memory."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    grouped = df.where("us IS NOT NULL").groupBy("symbol")
    made = grouped.transformWithStateInPandas(processor, StructType.fromDDL(out), "Append", "ProcessingTime",
                                              None if initial is None else initial.groupBy("symbol"))
    return made.select("symbol", F.timestamp_micros("us").alias("ts"), *[c for c in made.columns if c not in ("symbol", "us")])


# ---- closed bars ------------------------------------------------------------------------------

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
BAR_OUT = ("symbol string, us bigint, open double, high double, low double, close double, volume double, action string, kept int, "
           "rv_5 double, rv_15 double")


class ClosedBars(InOrder):
    """Older rows are dropped, an equal open time replaces, a newer one appends; the last ``keep`` closes are a ring in list state."""

    def __init__(self, keep: int, windows: tuple[int, ...], span_seconds: int, idle_seconds: float | None = None):
        super().__init__(span_seconds, idle_seconds)
        self.keep, self.windows = keep, windows

    def open(self, handle):
        self.last = handle.getValueState("last", "us bigint", self.ttl)
        self.closes = handle.getListState("closes", "close double", self.ttl)

    def advance(self, key, rows):
        last = self.last.get()[0] if self.last.exists() else None
        ring = np.array([c for (c,) in self.closes.get()], float) if self.closes.exists() else np.zeros(0)
        rows = rows[rows["us"] >= last].reset_index(drop=True) if last is not None else rows
        us, close = rows["us"].to_numpy(), rows["close"].to_numpy(float)
        if not len(us):
            return None
        again = np.concatenate([[us[0] == last], us[1:] == us[:-1]])
        if again[0]:
            ring = ring[:-1]
        group = np.cumsum(np.concatenate([[False], us[1:] != us[:-1]]))
        final = close[np.concatenate([us[1:] != us[:-1], [True]])]
        chain = np.concatenate([ring, final])
        place = len(ring) + group                           # of the row's open time in the chain
        kept = np.minimum(place + 1, self.keep)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.log(chain)
            own = np.where(place > 0, np.log(close) - logs[np.maximum(place - 1, 0)], np.nan) ** 2
            squares = np.diff(logs) ** 2
        back = np.concatenate([[0.0], np.cumsum(np.nan_to_num(squares))])
        bad = np.concatenate([[0], np.cumsum(np.isnan(squares))])
        out = _frame(key, us, **{c: rows[c].to_numpy(float) for c in BAR_COLUMNS}, action=np.where(again, "replace", "append"), kept=kept.astype(np.int32))
        for w in self.windows:
            first, end = np.maximum(place - w, 0), np.maximum(place - 1, 0)
            whole = (place >= w) & (bad[end] == bad[first])
            out[f"rv_{w}"] = np.where(whole, np.sqrt(np.maximum(own + back[end] - back[first], 0.0) / w), np.nan)
        self.closes.put([(float(c),) for c in chain[-self.keep:]])
        self.last.update((int(us[-1]),))
        return out


def _frame(key, us: np.ndarray, **columns) -> pd.DataFrame:
    return pd.DataFrame({"symbol": [key[0]] * len(us), "us": us.astype(np.int64), **columns})


def closed_bars(bars: DataFrame, keep: int, base_seconds: int, idle_seconds: float | None = None) -> DataFrame:
    """Monotone bar stream per symbol with realized volatility of 5 and 15 rows from the ring of closes."""
    rows = bars.select("symbol", F.unix_micros("ts").alias("us"), *[F.col(c).cast("double").alias(c) for c in BAR_COLUMNS])
    return run_in_order(rows, ClosedBars(keep, (5, 15), base_seconds * SPAN_ROWS, idle_seconds), BAR_OUT)


# ---- basis ------------------------------------------------------------------------------------

class Basis(InOrder):
    """Basis per row and at complete coarse buckets; a partial bucket never shows.  Rows not newer than the last one are dropped."""

    def __init__(self, interval_seconds: int, base_seconds: int, idle_seconds: float | None = None):
        super().__init__(base_seconds * SPAN_ROWS, idle_seconds)
        self.interval, self.need = interval_seconds, interval_seconds // base_seconds

    def open(self, handle):
        self.state = handle.getValueState("basis", "last bigint, prev double, bucket bigint, seen bigint, shown double, shown_change double", self.ttl)

    def advance(self, key, rows):
        last, prev, bucket, seen, shown, change = self.state.get() if self.state.exists() else (None,) * 3 + (0, None, None)
        rows = rows.drop_duplicates("us")
        rows = rows[rows["us"] > last] if last is not None else rows
        us = rows["us"].to_numpy()
        if not len(us):
            return None
        spot = rows["close"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            rel = np.where(np.abs(spot) > 1e-12, rows["um_close"].to_numpy(float) / spot - 1.0, np.nan)
        at = us // 1_000_000 // self.interval
        starts = np.concatenate([[at[0] != bucket], at[1:] != at[:-1]])
        run = np.maximum.accumulate(np.where(starts, np.arange(len(us)), -1))
        count = np.where(run >= 0, np.arange(len(us)) - run + 1, seen + 1 + np.arange(len(us)))
        done = (count == self.need) & ~np.isnan(rel)
        nan = lambda v: np.nan if v is None else v
        coarse = pd.Series(np.concatenate([[nan(shown)], rel[done]]))
        steps = np.concatenate([[nan(change)], coarse.diff().to_numpy()[1:]])
        which = np.cumsum(done)
        out = _frame(key, us, basis_rel=rel, basis_change=np.diff(np.concatenate([[nan(prev)], rel])), coarse_rel=coarse.to_numpy()[which], coarse_change=steps[which])
        none = lambda v: None if np.isnan(v) else float(v)
        self.state.update((int(us[-1]), none(rel[-1]), int(at[-1]), int(count[-1]), none(coarse.iloc[-1]), none(steps[-1])))
        return out


def basis(pairs: DataFrame, interval_seconds: int, base_seconds: int, idle_seconds: float | None = None) -> DataFrame:
    rows = pairs.select("symbol", F.unix_micros("ts").alias("us"), "close", "um_close")
    return run_in_order(rows, Basis(interval_seconds, base_seconds, idle_seconds),
                        "symbol string, us bigint, basis_rel double, basis_change double, coarse_rel double, coarse_change double")


# ---- price profiles ---------------------------------------------------------------------------

class Profile(InOrder):
    """Decayed mass per price bin, kept in map state by ``RANGE_BINS`` bins with the step at which it was last right.

    A span reads and writes only the ranges that its rows' windows and contributions touch; all others decay by the number
    of steps when they are next read.  Every ``SWEEP`` steps ranges whose mass has faded below ``floor`` on all horizons
    are removed, so a horizon with decay keeps no range longer than it takes to fade, and what is read later is short by
    less than ``floor`` a bin.  ``read`` makes features from the masses around each row.
    """

    def __init__(self, half_lives: dict, kinds: int, bins: int, reach: int, names: list[str], read: Callable, span_seconds: int,
                 floor: float = 1e-12, idle_seconds: float | None = None):
        super().__init__(span_seconds, idle_seconds)
        self.decays = np.array([decay_of(h) for h in half_lives.values()])
        self.kinds, self.bins, self.reach, self.names, self.read, self.floor = kinds, bins, reach, names, read, floor

    def open(self, handle):
        self.clock = handle.getValueState("clock", "last bigint, step bigint", self.ttl)
        self.ranges = handle.getMapState("ranges", "kind int, part bigint", "step bigint, mass array<double>", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows ``kind, bin, mass`` (one mass a horizon) of a batch profile, and ``us`` of the last row that it holds."""
        for (kind, part), rows in initialState.groupby([initialState["kind"], initialState["bin"] // RANGE_BINS]):
            mass = np.zeros((len(self.decays), RANGE_BINS))
            mass[:, rows["bin"].to_numpy(int) % RANGE_BINS] = np.stack(list(rows["mass"]), axis=1)
            self._put(int(kind), int(part), 0, mass)
        self.clock.update((int(initialState["us"].max()), 0))

    def _put(self, kind: int, part: int, step: int, mass: np.ndarray) -> None:
        self.ranges.updateValue((kind, part), (step, mass.ravel().tolist()))

    def _get(self, kind: int, part: int, step: int) -> np.ndarray:
        if not self.ranges.containsKey((kind, part)):
            return np.zeros((len(self.decays), RANGE_BINS))
        at, mass = self.ranges.getValue((kind, part))
        return np.array(mass).reshape(len(self.decays), RANGE_BINS) * (self.decays ** (step - at))[:, None]

    def advance(self, key, rows):
        last, step = self.clock.get() if self.clock.exists() else (None, 0)
        rows = rows.drop_duplicates("us")
        rows = rows[rows["us"] > last] if last is not None else rows
        us = rows["us"].to_numpy()
        if not len(us):
            return None
        before, out, size = step, [], rows_at_once(self.decays)
        for lo in range(0, len(rows), size):
            made, step = self._block(rows.iloc[lo:lo + size], step)
            out.append(made)
        if before // SWEEP != step // SWEEP:
            self._sweep(step)
        self.clock.update((int(us[-1]), int(step)))
        found = np.concatenate(out)
        return _frame(key, us, **{n: found[:, i] for i, n in enumerate(self.names)})

    def _block(self, rows: pd.DataFrame, step: int) -> tuple[np.ndarray, int]:
        k, b = np.cumsum(rows["valid"].to_numpy(int)), rows["b"].to_numpy(int)
        (bin_, row), (kind, _), (w, _) = flat(rows["bins"]), flat(rows["kinds"]), flat(rows["mass"])
        bin_ = bin_.astype(np.int64)
        near, there = window_of(b, self.reach, self.bins)
        seen = np.zeros((self.kinds, len(self.decays), *near.shape))
        end = step + int(k[-1])
        for q in range(self.kinds):
            mine = kind == q
            given = np.unique(bin_[mine] // RANGE_BINS)
            parts = np.union1d(np.unique(near[there] // RANGE_BINS), given)
            if not len(parts):
                continue
            column = lambda v: np.searchsorted(parts, v // RANGE_BINS) * RANGE_BINS + v % RANGE_BINS  # noqa: E731, B023
            carry = np.concatenate([self._get(q, int(p), step) for p in parts], axis=1)
            after = masses(carry, self.decays, k, row[mine], column(bin_[mine]), w[mine])
            where = column(np.where(there, near, parts[0] * RANGE_BINS))
            seen[q] = np.where(there[None], np.take_along_axis(after, where[None].repeat(len(self.decays), 0), axis=2), 0.0)
            for p in given:
                i = int(np.searchsorted(parts, p)) * RANGE_BINS
                self._put(q, int(p), end, after[:, -1, i:i + RANGE_BINS])
        return self.read(seen, b), end

    def _sweep(self, step: int) -> None:
        gone = [at for at, (then, mass) in self.ranges.iterator()
                if (np.array(mass).reshape(len(self.decays), RANGE_BINS) * (self.decays ** (step - then))[:, None]).max() < self.floor]
        for at in gone:
            self.ranges.removeKey(at)


def _profile(bars: DataFrame, mass: Column, valid: Column, b: Column, processor: Profile, initial: DataFrame | None) -> DataFrame:
    rows = bars.select("symbol", F.unix_micros("ts").alias("us"), valid.alias("valid"), F.coalesce(b, F.lit(-1)).alias("b"), mass.alias("_m"))
    rows = rows.select("symbol", "us", "valid", "b", *[F.col(f"_m.{c}").alias(n) for c, n in (("kind", "kinds"), ("bin", "bins"), ("mass", "mass"))])
    return run_in_order(rows, processor, "symbol string, us bigint, " + ", ".join(f"{n} double" for n in processor.names), initial)


def initial_profile(snapshot: DataFrame, half_lives: dict, last: DataFrame) -> DataFrame:
    """A batch snapshot (``symbol, kind, bin, horizon, mass``) as initial state; ``last`` has each symbol's last row time ``ts``."""
    wide = snapshot.groupBy("symbol", "kind", "bin").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("horizon") == h, F.col("mass"))), F.lit(0.0)) for h in half_lives]).alias("mass"))
    return wide.join(last.select("symbol", F.unix_micros("ts").alias("us")), "symbol").select("symbol", "kind", "bin", "mass", "us")


def reaction_profile(bars: DataFrame, cfg: ReactionProfile, base_seconds: int, initial: DataFrame | None = None, floor: float = 1e-12,
                     idle_seconds: float | None = None) -> DataFrame:
    """Support below and resistance above every bar's close; decay advances on every row."""
    names, whole = [f"{s}_{h}" for h in cfg.half_lives for s in ("support_below", "resistance_above")], read_reactions(cfg)

    def read(seen, b):
        return whole(seen, b).reshape(len(b), len(cfg.half_lives), 6)[:, :, :2].reshape(len(b), -1)

    made = Profile(cfg.half_lives, 2, cfg.bins, cfg.local_window, names, read, base_seconds * SPAN_ROWS, floor, idle_seconds)
    out = _profile(bars, reaction_mass(cfg), F.lit(True), price_bin("close", cfg), made, initial)
    return out.select("symbol", "ts", *[F.coalesce(n, F.lit(float("nan"))).alias(n) for n in names])    # NaN comes back from Python as NULL


def volume_profile(bars: DataFrame, cfg: VolumeProfile, base_seconds: int, initial: DataFrame | None = None, floor: float = 1e-12,
                   idle_seconds: float | None = None) -> DataFrame:
    """The features of ``profiles.volume_profile_features`` of every bar; decay advances on rows with volume."""
    valid = F.coalesce((F.col("volume") != 0) & ~F.isnan("volume") & F.col("high").isNotNull() & F.col("low").isNotNull(), F.lit(False))
    made = Profile(cfg.half_lives, 1, cfg.bins, max(cfg.local_window, cfg.neighbors), volume_names(cfg), read_volume(cfg), base_seconds * SPAN_ROWS, floor, idle_seconds)
    return _profile(bars, volume_mass(cfg), valid, volume_bin(cfg), made, initial)
