"""Hand-computed cases and brute-force checks of single operators."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import (audit, candles, clean, features as fe, metrics as mt, oneway as ow, policy as po, profiles as pr,
                               quantiles as qt, records as rc, resample, survival as sv, targets as tg)
from barloom.operators.ordered import Layout
from barloom.sources import committed, store

LAY = Layout(base_seconds=60, rows=8)


def minutes(spark, rows, cols, start="2026-01-01", symbol="s"):
    t0 = pd.Timestamp(start)
    pdf = pd.DataFrame(rows, columns=cols)
    pdf.insert(0, "ts", [t0 + pd.Timedelta(minutes=i) for i in range(len(rows))])
    pdf.insert(0, "symbol", symbol)
    return spark.createDataFrame(pdf)


OHLCV = ["open", "high", "low", "close", "volume"]


def test_candle_signs(spark):
    d = minutes(spark, [(10., 12., 9., 11., 100.), (10., 12., 8., 9., 25.), (10., 11., 9., 10., 999.), (10., 12., 9., 11., 0.)], OHLCV)
    got = candles.shape_features(d).orderBy("ts").toPandas()
    assert list(got["candle_signed_vol"]) == [1, -1, 0, 1]
    assert list(got["candle_up_down_vol_log_ratio"]) == [1, -1, 0, 0]


def test_volume_split_sign(spark):
    d = minutes(spark, [(10., 12., 9., 11., 30., 20., 10.), (10., 12., 8., 9., 5., 2., 3.), (10., 11., 9., 10., 10., 5., 5.)], OHLCV + ["up_volume", "down_volume"])
    assert list(candles.shape_features(d).orderBy("ts").toPandas()["candle_up_down_vol_log_ratio"]) == [1, -1, 0]


def test_streak_literal(spark):
    d = minutes(spark, [(1., 2., 0., 2., 1.)] * 3 + [(2., 2., 0., 1., 1.), (1., 2., 0., 2., 1.), (1., 2., 0., 1., 1.), (1., 2., 0., 2., 1.)], OHLCV)
    assert list(candles.signed_streak(d, "k", Layout(rows=2)).orderBy("ts").toPandas()["k"]) == [1, 2, 3, -1, 1, 0, 1]


def test_complete_interval_is_visible_on_its_last_row(spark):
    d = minutes(spark, [(float(i), i + 1., i - 1., i + .5, 1.) for i in range(11)], OHLCV)
    full = resample.complete_bars(d, "5m", 60)
    assert full.count() == 2
    seen = resample.align_to_base(d, full.withColumn("x", F.col("close")), ["x"], LAY).orderBy("ts").toPandas()["x"]
    assert seen[:4].isna().all() and seen[4] == 4.5 and seen[8] == 4.5 and seen[9] == 9.5
    assert resample.complete_bars(d.where(F.minute("ts") != 7), "5m", 60).count() == 1


def test_interval_labels():
    assert list(resample.interval_rules(["1h", "1h", "1w"])) == ["1h", "1w"]
    with pytest.raises(ValueError):
        resample.interval_rules(["7h"])


def test_gap_blocks_differ_from_frozen_rows(spark):
    rows = [(float(i),) * 4 + (10.,) for i in range(3)] + [(3., 3., 3., 3., 99.)] * 3 + [(9., 9., 9., 9., 1.)] * 2
    d = minutes(spark, rows, OHLCV)
    g = clean.gap_blocks(d, 3, LAY).orderBy("ts").toPandas()
    assert list(g["gap"]) == [False] * 3 + [True] * 3 + [False] * 2
    assert set(g["block_start"].dropna()) == {3} and set(g["block_end"].dropna()) == {5}
    assert clean.drop_frozen(d, 2, LAY).count() == 6  # the leading row of the block stays


def test_repair_invariants(spark):
    rng = np.random.default_rng(3)
    rows, c = [], 100.0
    for i in range(60):
        o, c = c, c + rng.normal()
        rows.append((o, max(o, c) + .5, min(o, c) - .5, c, 10. + i))
    d = minutes(spark, rows, OHLCV).where(~F.minute("ts").between(20, 26))
    out = clean.repair(d, 60, min_len=3, layout=LAY).orderBy("ts").toPandas()
    assert len(out) == 60 and out["gap"].sum() >= 6
    gap = out[out["gap"]]
    assert (gap["high"] >= gap[["open", "close"]].max(axis=1) - 1e-9).all() and (gap["low"] <= gap[["open", "close"]].min(axis=1) + 1e-9).all()
    after = out.iloc[gap.index[-1] + 1]
    assert abs(gap["close"].iloc[-1] - after["open"]) < 1e-6  # the bridge ends on the right anchor
    assert (out["volume"] > 0).all()
    again = clean.repair(d, 60, min_len=3, layout=Layout(base_seconds=60, rows=64)).orderBy("ts").toPandas()
    np.testing.assert_allclose(out["close"], again["close"], atol=1e-9)  # draws depend on the row, not on the partitioning


def test_draws_follow_histogram(spark):
    obs = spark.range(4000).select(F.lit("s").alias("symbol"), F.lit("returns").alias("kind"), F.when(F.col("id") % 4 == 0, 10.0).otherwise(0.0).alias("x"))
    h = clean.fit_histograms(obs, 10)
    assert h.count() == 2
    d = spark.range(4000).withColumn("symbol", F.lit("s")).join(clean.sampler_table(h), "symbol")
    x = d.select(clean.draw(F.lit("returns"), ["id"], 1, "t").alias("x")).toPandas()["x"]
    assert 0.2 < (x >= 9).mean() < 0.3 and x.between(0, 10).all() and not x.between(1.01, 8.99).any()


def test_exact_quantiles_and_ranks(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(700), rng.normal(size=1300)])  # a third of the rows share one value
    d = spark.createDataFrame(pd.DataFrame({"g": "k", "i": range(len(x)), "x": x})).repartition(5)
    q = {r["q"]: r["quantile"] for r in qt.exact_quantiles(d, ["g"], "x", [0.0, 0.1, 0.5, 0.77, 1.0], buckets=16).collect()}
    for p, v in q.items():
        assert abs(v - np.quantile(x, p)) < 1e-12
    r = qt.average_ranks(d, ["g"], "x", "r", buckets=16).orderBy("i").toPandas()["r"]
    np.testing.assert_allclose(r, pd.Series(x).rank())
    pos = qt.row_positions(d, ["g"], "x", ["i"], "p", buckets=16).orderBy("p").toPandas()
    assert list(pos["p"]) == list(range(len(x))) and pos["x"].is_monotonic_increasing


def test_reaction_profile_matches_replay(spark, bars):
    cfg = pr.ReactionProfile(price_min=20., price_max=90., step=1.0, neighbors=1.5, local_window=10, half_lives={"short": 3, "long": 30, "all": None})
    d = spark.createDataFrame(bars)
    outs = [pr.reaction_profile_features(d, cfg, Layout(base_seconds=60, rows=r)).orderBy("symbol", "ts").toPandas() for r in (16, 4096)]
    cols = [c for c in outs[0].columns if c.startswith("rp_")]
    np.testing.assert_allclose(outs[0][cols].to_numpy(float), outs[1][cols].to_numpy(float), rtol=1e-9, atol=1e-10)
    # plain loop over series "a", horizon short
    a = bars[bars["symbol"] == "a"].sort_values("ts")
    mass, want = np.zeros((2, 70)), []
    for r in a.itertuples():
        mass *= 0.5 ** (1 / 3)
        rng = r.high - r.low
        s = max(min(r.open, r.close) - r.low, 0) / rng * max(np.log(r.close / r.low), 0)
        t = max(r.high - max(r.open, r.close), 0) / rng * max(np.log(r.high / r.close), 0)
        for kind, p, st in ((0, r.low, s), (1, r.high, t)):
            b = int((p - 20) // 1)
            for k in (-1, 0, 1):
                mass[kind, b + k] += st * max(1 - abs(k) / 1.5, 0)
        b = int((r.close - 20) // 1)
        dist = np.arange(1, 11)
        want.append((mass[0, b - dist] / (1 + dist)).sum())
    got = outs[0][outs[0]["symbol"] == "a"]["rp_short_support_below"]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_volume_profile_decay_skips_zero_volume(spark, bars):
    cfg = pr.VolumeProfile(price_min=20., price_max=90., step=1.0, local_window=10, half_lives={"short": 5, "all": None})
    d = spark.createDataFrame(bars)
    outs = [pr.volume_profile_features(d, cfg, Layout(base_seconds=60, rows=r)).orderBy("symbol", "ts").toPandas() for r in (7, 4096)]
    cols = [c for c in outs[0].columns if c.startswith("vp_")]
    np.testing.assert_allclose(outs[0][cols].to_numpy(float), outs[1][cols].to_numpy(float), rtol=1e-8, atol=1e-9)
    snap = pr.snapshot(pr.volume_steps(d, cfg), cfg.half_lives).where("symbol = 'a' AND horizon = 'all'").toPandas()
    assert abs(snap["mass"].sum() - bars[bars["symbol"] == "a"]["volume"].sum()) < 1e-6


def _counts(spark, values):
    pdf = pd.DataFrame({"f": np.array(values, float), "p": 0.5, "y": 1, "w": 1.0})
    return ow.distinct_counts(spark.createDataFrame(pdf), ["f"], "p", "y", "w")


def test_tie_aware_groups(spark):
    c = _counts(spark, [0.0] * 80 + list(range(1, 21)))
    bins = ow.observed_bins(c, ow.bin_edges(c, 5, 2)).orderBy("bin").toPandas()
    assert list(bins["rows"]) == [80, 5, 5, 5, 5]
    c = _counts(spark, [-2] * 2 + [-1] * 5 + [0] * 10 + [1] * 5 + [2] * 2)
    e = ow.bin_edges(c, 5, 1).toPandas()
    assert set(e["left_edge"]) <= {-2, -1, 0, 1, 2} and (e["left_edge"] <= e["right_edge"]).all()
    c = _counts(spark, [0.0] * 10 + [i / 100 for i in range(1, 9)] + [0.5] + [1.0] * 10)
    bins = ow.observed_bins(c, ow.bin_edges(c, 6, 2)).toPandas()
    assert bins["rows"].min() >= 2 and bins["rows"].sum() == 29


def test_recency_weights(spark):
    w = spark.range(4).select(tg.recency_weight(F.col("id"), 4).alias("w")).toPandas()["w"]
    np.testing.assert_allclose(w, [1, 1 + 1 / 6, 1 + 1 / 3, 1.5])


def test_duplicate_key_fails(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1)], "symbol string, ts int")
    with pytest.raises(Exception, match="duplicate keys"):
        tg.require_unique(d).collect()


def _backtest(spark, ticks):
    d = spark.createDataFrame([(0.9, 0.4, 0.7, 0.01, 1, dt.datetime(2026, 1, 1), "s")],
                              "proba_up double, ask_yes double, ask_no double, tick_size double, actual_up int, ts timestamp, symbol string")
    t = po.replay_trades(d, po.Fee(), 0.0, price_cap=0.99, price_mode="entry_price_plus_ticks", ticks=ticks)
    return po.replay_summary(t, LAY).first()["total_profit"]


def test_backtest_literal(spark):
    assert abs(_backtest(spark, 0) - 0.60) < 1e-9 and abs(_backtest(spark, 5) - 0.55) < 1e-9


def test_bucket_medians(spark):
    d = spark.createDataFrame([(1, 101., 0.40), (1, 101., 0.50), (2, 103., 0.57)], "b int, btc_open double, ask double")
    r = {x["b"]: x for x in po.bucket_medians(d, ["b"], ["btc_open", "ask"]).collect()}
    assert r[1]["ask"] == pytest.approx(0.45) and r[1]["observations"] == 2 and r[2]["btc_open"] == 103.0


def test_scenario_walk(spark):
    draws = spark.createDataFrame([("s", 1, dt.datetime(2026, 1, 1), i, s, 9) for i, s in ((0, 2), (1, 1), (3, 0), (4, 5))],
                                  "symbol string, seed int, event_day timestamp, _i bigint, streak int, starts_per_day int")
    n = spark.createDataFrame([("s", 10)], "symbol string, n bigint")
    r = sv.replay(draws, [2], 0.5, ["symbol"], n).orderBy("length", "wins").toPandas()
    # start 0 wins two steps, start 1 overlaps, start 3 loses at once, start 4 wins two
    assert len(r) == 3 and sorted(r["pnl"]) == [-1.0, 3.0, 3.0]


def test_redeem_reasons(spark):
    c = ["0x" + str(i) * 64 for i in range(1, 6)]
    pos = spark.createDataFrame([(1, c[0], "t1", True, False, "btc-up-1"), (2, c[0], "t1", True, False, "btc-up-1"), (3, c[1], "t2", True, True, "btc-up-1"),
                                 (4, c[1], "t2", True, False, "btc-up-1"), (5, c[2], "t3", False, False, "btc-up-1"), (6, c[3], "t4", True, False, "btc-up-1"),
                                 (7, c[4], "tx", True, False, "btc-up-1"), (8, "", "t", True, False, "btc-up"), (9, "zz", "t", True, False, "btc-up"), (10, c[0], "t", True, False, "btc-upper")],
                                "position_id int, condition_id string, asset string, redeemable boolean, negative_risk boolean, slug string")
    recs = spark.createDataFrame([("live", c[0], "t1", True, True, "pending"), ("live", c[1], "t2", True, True, "pending"), ("live", c[2], "t3", True, True, "pending"),
                                  ("live", c[4], "t5", True, True, "pending"), ("paper", c[3], "t4", True, True, "pending")],
                                 "mode string, condition_id string, asset string, resolved boolean, won boolean, status string")
    got = {r["position_id"]: r["reason"] for r in rc.redeem_candidates(pos, recs, "btc-up").collect()}
    assert got == {1: "eligible", 2: "duplicate_condition_id", 3: "negative_risk_unsupported", 4: "condition_already_blocked", 5: "not_redeemable",
                   6: "untracked_condition", 7: "position_asset_not_winning_record", 8: "missing_condition_id", 9: "invalid_condition_id"}


def test_settlement_precedence(spark):
    d = spark.createDataFrame([("yes", 1, 4.0, 10.0, 9.0), ("yes", 0, 4.0, 10.0, 9.0), ("none", None, 4.0, 10.0, -4.0)],
                              "trade_side string, actual_up int, stake double, shares_net double, realized_pnl double")
    a = rc.settle_records(d).toPandas()
    assert list(a["pnl"]) == [6.0, -4.0, -4.0] and list(a["payout"]) == [10.0, 0.0, 0.0]
    assert list(rc.settle_records(d, prefer_api=True).toPandas()["pnl"]) == [9.0, 9.0, -4.0]


def test_futures_column():
    assert fe.futures_close_column(["close", "um_btc_close", "um_btc_volume"]) == "um_btc_close"
    with pytest.raises(ValueError):
        fe.futures_close_column(["close", "UM_a_close", "um_b_close"])
    with pytest.raises(ValueError):
        fe.futures_close_column(["close"], configured="volume")


def test_metrics_absent_class(spark):
    d = spark.createDataFrame([(0.9, 1, 1.0, 1), (0.2, 1, 1.0, 1)], "p double, y int, w double, k int")
    r = mt.metrics_by(d, ["k"]).first()
    assert r["balanced_accuracy"] == pytest.approx(0.25) and r["precision"] == 1.0


def test_schema_check(spark):
    d = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert audit.schema_check(d, {"a": "int", "b": "float", "c": "int"}) == ["missing c", "type b: double != float"]
    with pytest.raises(ValueError):
        pr.validate_profile_features(["rp_x"], ["rp_y"])


def test_fit_results(spark, tmp_path):
    body = {"best": {"params": {"atr_period": 21, "ma_type_atr": "SMA"}}, "proxy_target": {"mode": "candle_up"},
            "metric": {"name": "extremes_vs_mid_ir_oof", "q_ext": 0.2, "q_mid": 0.2, "train_frac": 0.8, "stat": "mean_clip", "segments_count": 10}}
    (tmp_path / "ADX_target_5m_candle_up_pop512_x.json").write_text(json.dumps(body))
    (tmp_path / "ADX_target_5m_candle_up_pop512_y.json").write_text(json.dumps(body))  # same parameters: one feature
    (tmp_path / "MACD_target_15m_pop16_q0.1.json").write_text(json.dumps({"params": {"fast_period": 3}}))
    (tmp_path / "notes.json").write_text("{}")
    got = {r["feature"]: r for r in store.scan_fit_results(spark, str(tmp_path)).collect()}
    assert set(got) == {"ADX_fit_5m_candle_up_pop512_atrper21_matypatrSMA_qe0.2_qm0.2_tf0.8_stmc_sg10", "MACD_fit_15m_pop16_fasper3"}
    assert got["MACD_fit_15m_pop16_fasper3"]["horizon_minutes"] == 15


def test_feature_list_files(spark, tmp_path):
    j, t = tmp_path / "f.json", tmp_path / "f.txt"
    j.write_text(json.dumps({"recommended_features": ["b", "a", "b", "old_x", "c"]}))
    t.write_text("created_utc=2026\n\nb\na\nb\nold_x\nc\n")
    for p in (j, t):
        got = [r["feature"] for r in store.load_feature_list(spark, str(p), ["c"], "^old_").orderBy("pos").collect()]
        assert got == ["b", "a"]


def test_upsert_normalises_keys(spark):
    old = spark.createDataFrame([("1 ", "a", "x", 9), ("nan", "b", "y", 1)], "k string, v string, extra string, n int")
    new = spark.createDataFrame([("1", "c", 2), (None, "d", 1), ("1", "z", 1)], "k string, v string, n int")
    for parts in (1, 5):                               # the sequence decides, not the partition
        both = store.upsert(old.repartition(parts), new.repartition(parts), ["k"], ["k", "v"], "n")
        assert sorted(r["v"] for r in both.collect()) == ["c", "d"]


def test_dataset_sink(spark, tmp_path):
    d = minutes(spark, [(1., 2., 0., 1.5, 1.)] * 5, OHLCV).withColumn("y", F.lit(1))
    meta = committed.write_dataset(d, str(tmp_path / "o"), "y", preview=2)
    assert meta["rows"] == 5 and meta["positives"] == 5
    assert committed.read_dataset(spark, str(tmp_path / "o"), "head")[0].count() == 2


def test_segment_information_ratio(spark):
    rng = np.random.default_rng(1)
    n = 4000
    amp = np.repeat([1.0, 2.0, 3.0, 4.0], n // 4)
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"row_idx": range(n), "x": x, "y": amp * (np.abs(x) > 1) + rng.normal(scale=.1, size=n)})
    d = spark.createDataFrame(pdf)
    s = mt.segment_scores(d, "x", "y", segments=4, train_frac=0.5, gap=5, q_ext=0.15, q_mid=0.2, clip_q=0.01, min_bucket=10)
    plain = mt.information_ratio(s, 4).first()["ir"]
    assert mt.information_ratio(s, 4, recency=(1.0, 1.5)).first()["ir"] > plain > 0


def test_medians_of_hot_buckets(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 40, 3000).astype(str)), "x": rng.integers(0, 50, 3000) / 4, "y": rng.normal(size=3000)})
    pdf.loc[::7, "x"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = pdf.groupby("k").agg(x=("x", "median"), y=("y", "median"), n=("k", "size"))
    for hot_rows in (10**6, 100):
        got = po.bucket_medians(d, ["k"], ["x", "y"], hot_rows).toPandas().set_index("k").loc[want.index]
        np.testing.assert_allclose(got["x"], want["x"])
        np.testing.assert_allclose(got["y"], want["y"])
        assert (got["observations"] == want["n"]).all()
