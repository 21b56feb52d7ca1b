"""Chunked kernels against plain loops, for several chunk sizes and shuffled input."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import averages as ma, features, ordered, recursions as rec
from barloom.operators.averages import apply_averages
from barloom.operators.ordered import Layout, asof, decayed, framed, index_rows, lagged, run_bounds, running

SIZES = [5, 64, 4096]


def lay(rows):
    return Layout(base_seconds=60, rows=rows)


def pull(df, *cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def same(a, b):
    np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", SIZES)
def test_running_and_islands(bar_frame, bars, rows):
    b = bars.sort_values(["symbol", "ts"])
    got = pull(running(bar_frame, lay(rows), s=("sum", F.col("volume")), m=("max", F.col("close")),
                       after=("min", F.col("low"), {"reverse": True, "inclusive": False})), "s", "m", "after")
    same(got["s"], b.groupby("symbol")["volume"].cumsum())
    same(got["m"], b.groupby("symbol")["close"].cummax())
    want = b.groupby("symbol")["low"].transform(lambda x: x[::-1].cummin().shift(1)[::-1])
    same(got["after"], want)
    flat = index_rows(bar_frame, lay(rows))
    runs = pull(run_bounds(flat, F.col("volume") > 50, lay(rows)), "run_start", "run_end", "_i")
    for _, g in runs.groupby("symbol"):
        vol = b[b["symbol"] == g["symbol"].iloc[0]]["volume"].to_numpy()
        start = 0
        for i in range(len(g)):
            start = i if i == 0 or vol[i] > 50 else start
            assert g["run_start"].iloc[i] == start


@pytest.mark.parametrize("rows", SIZES)
def test_frames_and_lags(bar_frame, bars, rows):
    b = bars.sort_values(["symbol", "ts"])
    got = pull(framed(bar_frame, lambda f, w: f.withColumn("x", F.sum("close").over(w.rowsBetween(-11, 0))), lay(rows), back=11), "x")
    same(got["x"], b.groupby("symbol")["close"].transform(lambda x: x.rolling(12, min_periods=1).sum()))
    lag = pull(lagged(bar_frame, {"p": ("close", 3), "n": ("close", -2)}, lay(rows)), "p", "n")
    same(lag["p"], b.groupby("symbol")["close"].shift(3))
    same(lag["n"], b.groupby("symbol")["close"].shift(-2))


@pytest.mark.parametrize("rows", SIZES)
def test_decay_and_asof(spark, bar_frame, bars, rows):
    b = bars.sort_values(["symbol", "ts"])
    got = pull(decayed(bar_frame, {"y": (F.col("volume"), 0.9), "z": (F.col("volume"), 0.999), "c": (F.col("volume"), 1.0)}, lay(rows)), "y", "z", "c")
    for name, a in (("y", 0.9), ("z", 0.999), ("c", 1.0)):
        out = []
        for _, g in b.groupby("symbol"):
            y = 0.0
            for v in g["volume"]:
                y = a * y + v
                out.append(y)
        same(got[name], out)
    ev = b.iloc[::9][["symbol", "ts", "close"]].rename(columns={"close": "e"})
    j = pull(asof(bar_frame.select("symbol", "ts", "close"), spark.createDataFrame(ev), lay(rows)), "e")
    want = pd.merge_asof(b.sort_values("ts"), ev.sort_values("ts"), on="ts", by="symbol").sort_values(["symbol", "ts"])
    same(j["e"], want["e"])


def _ema(x, n, a):
    out = [math.nan] * len(x)
    if len(x) >= n:
        out[n - 1] = float(np.mean(x[:n]))
        for i in range(n, len(x)):
            out[i] = a * x[i] + (1 - a) * out[i - 1]
    return out


def _kama(x, n):
    out, y = [math.nan] * len(x), x[n - 1]
    for i in range(n, len(x)):
        path = np.abs(np.diff(x[i - n:i + 1])).sum()
        er = 1.0 if path <= abs(x[i] - x[i - n]) or path < 1e-14 else abs(x[i] - x[i - n]) / path
        y += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - y)
        out[i] = y
    return out


def _vidya(x, n):
    out, y, d = [math.nan] * len(x), x[n - 1], np.diff(x)
    for i in range(n, len(x)):
        w = d[i - n:i]
        path = np.abs(w).sum()
        a = 2 / (n + 1) * (abs(w.sum()) / path if path >= 1e-14 else 0.0)
        y = a * x[i] + (1 - a) * y
        out[i] = y
    return out


@pytest.mark.parametrize("rows", [9, 4096])
def test_recursive_averages(bar_frame, bars, rows):
    b = bars.sort_values(["symbol", "ts"])
    got = pull(ma.apply_averages(bar_frame, {"ema": ("EMA", "close", 7), "rma": ("RMA", "close", 5), "kama": ("KAMA", "close", 6),
                                             "vidya": ("VIDYA", "close", 6), "mgd": ("MGD", "close", 5), "ahma": ("AHMA", "close", 4)}, lay(rows)),
               "ema", "rma", "kama", "vidya", "mgd", "ahma")
    want = {k: [] for k in ("ema", "rma", "kama", "vidya", "mgd", "ahma")}
    for _, g in b.groupby("symbol"):
        x = g["close"].to_numpy()
        want["ema"] += _ema(x, 7, 2 / 8)
        want["rma"] += _ema(x, 5, 1 / 5)
        want["kama"] += _kama(x, 6)
        want["vidya"] += _vidya(x, 6)
        for k, fn, n in (("mgd", rec.mcginley, 5), ("ahma", rec.ahrens, 4)):
            want[k] += [math.nan] * (n - 1) + fn(x, n, None)[0][n - 1:]
    for k in want:
        same(got[k], want[k])


def test_short_warmup_is_repaired(bar_frame, bars):
    """Chunks that start from a wrong guess are run again until every boundary agrees."""
    lo = lay(8)
    idx = index_rows(bar_frame, lo)
    got = pull(rec.recursive(idx, "close", "y", rec.mcginley, 30, 0, lo, warm=1), "y")
    want = np.concatenate([rec.mcginley(g["close"].to_numpy(), 30, None)[0] for _, g in bars.sort_values(["symbol", "ts"]).groupby("symbol")])
    same(got["y"], want)


def test_no_look_ahead(spark, bars):
    """Cutting the future off does not change earlier rows."""
    from barloom.operators import candles, features as fe
    a = bars[bars["symbol"] == "a"].sort_values("ts")
    cut = a["ts"].iloc[100]
    layout = lay(16)

    def build(pdf):
        d = candles.shape_lags(spark.createDataFrame(pdf), ["candle_ret_co"], 2, layout)
        d = candles.signed_streak(d, "streak", layout)
        return pull(fe.volatility_features(d, (1, 5), layout), "candle_ret_co_1m_lag2", "streak", "rv_5")

    full, part = build(a), build(a[a["ts"] <= cut])
    pd.testing.assert_frame_equal(full[full["ts"] <= cut].reset_index(drop=True), part)


@pytest.mark.parametrize("length", [15, 16, 17, 47, 48, 49, 50])
def test_averages_one_rule_for_all_lengths(spark, length):
    """Missing values give NULL and large levels keep their digits, whatever the length."""
    rng = np.random.default_rng(length)
    price = 1e8 + np.where(np.arange(220) % 2, 0.01, 0.0) + rng.normal(scale=1e-3, size=220)
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2026-01-01") + pd.to_timedelta(np.arange(220), unit="min"), "close": price, "volume": 1.0 + np.arange(220) % 5})
    pdf.loc[[30, 151], "close"] = None
    wanted = {m: (m, "close", length) for m in ("SMA", "WMA", "LINREG", "STD", "VWMA", "GMA", "MIN", "ALMA")}
    d = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = apply_averages(d, wanted, Layout(rows=64)).orderBy("ts").toPandas()
    x = pdf["close"]
    roll, v = x.rolling(length), pdf["volume"]
    ramp = np.arange(1, length + 1)
    want = {"SMA": roll.mean(), "STD": roll.apply(lambda w: np.std(w - w.mean()), raw=True), "MIN": roll.min(), "GMA": np.exp(np.log(x).rolling(length).mean()),
            "WMA": roll.apply(lambda w: w[0] + ((w - w[0]) * ramp).sum() / ramp.sum(), raw=True),
            "LINREG": roll.apply(lambda w: w[0] + np.polyval(np.polyfit(ramp, w - w[0], 1), length), raw=True),
            "VWMA": 1e8 + ((x - 1e8) * v).rolling(length).sum() / v.where(x.notna()).rolling(length).sum()}
    for name, series in want.items():
        assert (got[name].isna().to_numpy() == series.isna().to_numpy()).all(), name
        ok = series.notna().to_numpy()
        assert np.allclose(got[name].to_numpy(float)[ok], series.to_numpy(float)[ok], rtol=3e-15 if name == "MIN" else 1e-13, atol=0 if name != "STD" else 2e-7), name
    assert (got["ALMA"].isna() == want["SMA"].isna()).all()


def test_volatility_with_a_gap(spark):
    close = np.exp(np.random.default_rng(3).normal(scale=0.01, size=80).cumsum())
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2026-01-01") + pd.to_timedelta(np.arange(80), unit="min"), "close": close})
    d = spark.createDataFrame(pdf).withColumn("close", F.when(F.minute("ts") != 40, F.col("close")))
    got = features.volatility_features(d, windows=(16, 17), layout=Layout(rows=32)).orderBy("ts").toPandas()
    r = np.log(pdf["close"].where(np.arange(80) % 60 != 40)).diff()
    for n in (16, 17):
        want = np.sqrt((r * r).rolling(n).sum() / n)
        assert np.allclose(got[f"rv_{n}"].to_numpy(float), want.to_numpy(), equal_nan=True, rtol=1e-9)


def test_chained_averages_read_their_input_once_per_level(spark):
    from barloom.plans import REGISTRY
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    for name in ("nested_exponential_averages", "adx_wilder"):
        plan = REGISTRY[name].frame(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= 4, name


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "local-cluster[2,1,1024]"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:
            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Context

        class conf:
            values = {}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ordered.shared_path(Session, "settled")
    Session.conf.values["spark.checkpoint.dir"] = "hdfs://shared/folder"
    assert ordered.shared_path(Session, "settled").startswith("hdfs://shared/folder/settled-")


def test_a_burst_is_split_by_rows(spark):
    """All rows within one hour: several spans hold them, and the as-of join and the index stay exact."""
    rng = np.random.default_rng(9)
    ticks = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2026-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 3_600_000, 900)), unit="ms"), "n": range(900)})
    quotes = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2026-01-01") + pd.to_timedelta(np.sort(rng.choice(3_600_000, 40, replace=False)), unit="ms"), "q": np.arange(40.0)})
    burst = Layout(rows=100, by_rows=True)
    left, right = spark.createDataFrame(ticks.sample(frac=1, random_state=2)), spark.createDataFrame(quotes)
    sizes = [r["count"] for r in ordered.spanned(left, burst).groupBy("_span").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 250
    got = asof(left, right, burst).toPandas().sort_values("n")
    want = pd.merge_asof(ticks, quotes, on="ts", by="symbol")
    assert np.allclose(got["q"].to_numpy(float), want["q"].to_numpy(), equal_nan=True)
    from barloom.operators.targets import global_index
    index = global_index(left, tie=("n",), rows=100).orderBy("ts", "n").toPandas()["row_idx"]
    assert index.tolist() == list(range(900))
