"""Streams replayed over several micro-batches equal the batch operators."""

import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import features as fe, profiles as pr
from barloom.operators.ordered import Layout
from barloom.streaming import jobs, state

LAY = Layout(base_seconds=60, rows=32)


def _files(spark, bars, path, parts):
    b = bars.sort_values("ts").reset_index(drop=True)
    cuts = np.array_split(np.arange(len(b)), parts)
    for i, c in enumerate(cuts):
        spark.createDataFrame(b.iloc[c]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, path):
    return jobs.run_to_table(stream, path, extra_batches=False)


def test_closed_bars_equal_batch(spark, bars, tmp_path):
    live = _run(state.closed_bars(_files(spark, bars, str(tmp_path / "in"), 4), 241, 60), str(tmp_path / "out"))
    batch = fe.volatility_features(spark.createDataFrame(bars), (5, 15), LAY).select("symbol", "ts", F.col("rv_5").alias("b5"), F.col("rv_15").alias("b15"))
    j = live.join(batch, ["symbol", "ts"]).toPandas()
    assert len(j) == len(bars)
    np.testing.assert_allclose(j["rv_5"], j["b5"], atol=1e-12)
    np.testing.assert_allclose(j["rv_15"], j["b15"], atol=1e-12)


RP = pr.ReactionProfile(price_min=20., price_max=90., step=1.0, neighbors=1.5, local_window=10, half_lives={"short": 3, "all": None})
VP = pr.VolumeProfile(price_min=20., price_max=90., step=0.5, local_window=12, half_lives={"short": 3, "all": None})


def test_reaction_profile_equals_batch(spark, bars, tmp_path):
    live = _run(state.reaction_profile(_files(spark, bars, str(tmp_path / "in"), 4), RP, 60), str(tmp_path / "out"))
    batch = pr.reaction_profile_features(spark.createDataFrame(bars), RP, LAY).select("symbol", "ts", "rp_short_support_below", "rp_all_resistance_above")
    j = live.join(batch, ["symbol", "ts"]).toPandas()
    assert len(j) == len(bars)
    np.testing.assert_allclose(j["support_below_short"], j["rp_short_support_below"], atol=1e-9)
    np.testing.assert_allclose(j["resistance_above_all"], j["rp_all_resistance_above"], atol=1e-9)


def test_volume_profile_goes_on_from_a_snapshot(spark, bars, tmp_path):
    """A stream that starts from the batch profile of the first rows equals the batch over all rows."""
    names = pr.volume_names(VP)
    b = bars.sort_values(["symbol", "ts"])
    place = b.groupby("symbol").cumcount()
    past, rest = spark.createDataFrame(b[place < 20]), b[place >= 20]
    snapshot = pr.snapshot(pr.volume_steps(past, VP), VP.half_lives, LAY)
    initial = state.initial_profile(snapshot, VP.half_lives, past.groupBy("symbol").agg(F.max("ts").alias("ts")))
    live = _run(state.volume_profile(_files(spark, rest, str(tmp_path / "in"), 4), VP, 60, initial), str(tmp_path / "out"))
    batch = pr.volume_profile_features(spark.createDataFrame(bars), VP, LAY).select("symbol", "ts", *[F.col(n).alias(f"b_{n}") for n in names])
    j = live.join(batch, ["symbol", "ts"]).toPandas()
    assert len(j) == len(rest)
    for n in names:
        np.testing.assert_allclose(j[n], j[f"b_{n}"], atol=1e-6)


def test_older_rows_are_dropped(spark, bars, tmp_path):
    path = str(tmp_path / "in")
    a = bars[bars["symbol"] == "a"].sort_values("ts")
    for part in (a.iloc[10:20], a.iloc[:5], a.iloc[19:22]):  # late rows, then the last row again
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _run(state.closed_bars(s, 241, 60), str(tmp_path / "out")).toPandas()
    assert out["ts"].min() == a["ts"].iloc[10] and (out["action"] == "replace").sum() == 1 and len(out) == 13


def test_an_idle_key_expires(spark, bars, tmp_path):
    """State older than its time to live is gone: the ring starts anew after a pause."""
    path, a = str(tmp_path / "in"), bars[bars["symbol"] == "a"].sort_values("ts")

    def add(part):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
        s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        return _run(state.closed_bars(s, 241, 60, idle_seconds=8), str(tmp_path / "out")).toPandas().sort_values("ts")

    assert add(a.iloc[:20])["kept"].tolist() == list(range(1, 21))
    time.sleep(10)
    assert add(a.iloc[20:30])["kept"].tolist()[-10:] == list(range(1, 11))


class _Memory:
    """State of one key in dictionaries, as the processors see it."""

    def __init__(self):
        self.timers, self.maps = set(), {}

    def getMapState(self, name, *_):
        d = self.maps.setdefault(name, {})
        return SimpleNamespace(containsKey=d.__contains__, getValue=d.__getitem__, updateValue=d.__setitem__, removeKey=d.pop, iterator=lambda: iter(list(d.items())))

    def getValueState(self, name, *_):
        box = []
        return SimpleNamespace(exists=lambda: bool(box), get=lambda: box[-1], update=box.append)

    getListState = None

    def registerTimer(self, ms):
        self.timers.add(ms)

    def fire(self, processor, key):
        due, self.timers = sorted(self.timers), set()
        for ms in due:
            yield from processor.handleExpiredTimer(key, None, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))


def test_backlog_is_worked_off_span_by_span():
    """A symbol's backlog in shuffled slices: every call has one span, in order, and nothing stays behind."""
    calls = []

    class Probe(state.InOrder):
        def advance(self, key, rows):
            calls.append(rows["us"].tolist())
            return rows

    probe, memory = Probe(600), _Memory()
    probe.init(memory)
    us = np.random.default_rng(1).permutation(np.arange(5000) * 60_000_000)
    assert not list(probe.handleInputRows(("a",), (pd.DataFrame({"us": p}) for p in np.array_split(us, 7)), None))
    list(memory.fire(probe, ("a",)))
    assert max(map(len, calls)) == 10 and sum(calls, []) == sorted(us.tolist()) and not memory.maps["pending"]


def test_faded_ranges_are_removed(monkeypatch):
    """Prices wander through thousands of bins: few ranges stay, and what is read differs by less than the floor."""
    monkeypatch.setattr(state, "SWEEP", 200)
    rows = pd.DataFrame({"us": np.arange(4000) * 60_000_000, "valid": True, "b": np.arange(4000) // 2})
    rows["bins"], rows["kinds"], rows["mass"] = ([np.array([max(v, 0)]) for v in rows["b"] - 1], [np.array([0])] * 4000, [np.array([1.0])] * 4000)
    read = lambda seen, b: seen[0].sum(axis=2).T
    found, kept = {}, {}
    for floor in (1e-9, 0.0):
        p, memory = state.Profile({"short": 5, "long": 20}, 1, 5000, 40, ["short", "long"], read, 15_360, floor), _Memory()
        p.init(memory)
        found[floor] = pd.concat([p.advance(("a",), rows.iloc[i:i + 256]) for i in range(0, 4000, 256)])
        kept[floor] = len(memory.maps["ranges"])
    assert kept[0.0] == 125 and kept[1e-9] <= 40
    assert np.abs(found[1e-9][["short", "long"]].to_numpy() - found[0.0][["short", "long"]].to_numpy()).max() < 81e-9


def test_feature_vector_names_missing(spark):
    d = spark.createDataFrame([("s", 1.0, None)], "symbol string, a double, b double")
    r = jobs.feature_vector(d, ["b", "a", "c"]).first()
    assert r["missing"] == ["b", "c"] and r["a"] == 1.0
