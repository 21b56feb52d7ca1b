"""Queries against DuckDB on events with prices of zero, which the smallest given tables lack."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import profiles as pr
from barloom.operators.ordered import Layout
from barloom.plans import REGISTRY
from compare import compare, connect


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """175 hours of three symbols; every 17th price is zero, so bars open, bottom and close at zero."""
    folder = tmp_path_factory.mktemp("odd")
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 7 MINUTE AS ts, i % 50 AS user_id, ['view', 'click', 'error'][1 + i % 3] AS event_type,
        CASE WHEN i % 17 = 0 THEN 0.0 ELSE (i * 37 % 1000) / 10.0 END::DOUBLE AS value, '{{"k": ' || i % 90 || '}}' AS props FROM range(1500) r(i)) TO '{folder}/events.parquet'""")
    return str(folder)


def matches(name, spark, folder):
    ok, _, rows, message = compare(REGISTRY[name], spark, connect(folder), folder)
    assert ok and rows, message
    return REGISTRY[name].frame(spark, folder)


def test_open_market_at_price_zero_has_no_outcome(spark, odd):
    assert matches("market_outcomes", spark, odd).where("event_id = 68").first()["actual_up"] is None   # 68 % 5 = 3, 68 % 17 = 0


def test_stake_requested_for_no_shares_has_an_infinite_price(spark, odd):
    found = matches("order_fills", spark, odd)
    assert found.where("event_id = 17").first()["fill_price"] == float("inf")
    assert found.where("event_id = 90").first()["fill_price"] is None       # a response without shares


def test_suspicion_of_predictions_that_all_tie(spark, odd, tmp_path):
    """Volumes so large that every prediction is zero to the digits that count."""
    duckdb.execute(f"COPY (SELECT * REPLACE (replace(props, ': ', ': 1000') AS props) FROM '{odd}/events.parquet') TO '{tmp_path}/events.parquet'")
    categories = {r["category"] for r in matches("suspicion_report", spark, str(tmp_path)).collect()}
    assert "insufficient" not in categories


@pytest.mark.parametrize("name", ["reaction_strengths", "reaction_kernel", "reaction_snapshot", "profile_state"])
def test_reactions_at_price_zero_are_limits(name, spark, odd):
    """Infinite where a wick ends at zero, NaN where there is none, and no finite mass is lost beside them."""
    found = matches(name, spark, odd)
    values = found.columns[-1]
    assert found.where(f"isnan({values})").count() and found.where(f"abs({values}) < double('inf')").count()


def test_snapshot_features_at_price_zero_are_limits(spark, odd):
    found = matches("reaction_snapshot_features", spark, odd)
    assert found.where("isnan(imbalance)").count() and found.where("resistance_above > 0").count()


def test_snapshot_features_of_a_last_price_outside_the_bins(spark, odd, tmp_path):
    """At 110 the bins from 90 to 99 are within reach."""
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id >= 1497 THEN 110.0 WHEN value = 0 THEN 5.0 ELSE value END AS value) FROM '{odd}/events.parquet') TO '{tmp_path}/events.parquet'")
    assert matches("reaction_snapshot_features", spark, str(tmp_path)).count() == 9


def test_profile_features_after_a_price_of_zero(spark, odd):
    found = matches("reaction_profile_features", spark, odd)
    assert found.where("isnan(support_below)").count()
    assert found.where("resistance_above > 0 AND resistance_above < double('inf')").count()


def test_infinite_masses_are_carried_over_chunks(spark):
    """A wick to zero at hour 3, an open at zero at hour 30; chunks of eight rows."""
    bars = spark.range(60).select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.when(F.col("id") == 30, 0.0).otherwise(5.5).alias("open"),
                                  F.lit(6.5).alias("high"), F.when(F.col("id").isin(3, 30), 0.0).otherwise(4.5).alias("low"), F.lit(5.6).alias("close"))
    cfg = pr.ReactionProfile(price_max=100.0, step=1.0, neighbors=0.0, local_window=20, half_lives={"short": 2, "all": None}, positive_only=False)
    got = pr.reaction_profile_features(bars, cfg, Layout(base_seconds=3600, rows=8)).orderBy("ts").toPandas()
    for h in cfg.half_lives:
        below, above = got[f"rp_{h}_support_below"], got[f"rp_{h}_resistance_above"]
        assert np.isfinite(below[:3]).all() and np.isinf(below[3:30]).all() and np.isnan(below[30:]).all() and np.isfinite(above).all() and (above > 0).all()


def test_streamed_profile_after_a_price_of_zero(spark, odd):
    found = matches("stream_reaction_profile", spark, odd)
    assert found.where("isnan(support_below_short)").count() and found.where("resistance_above_all > 0").count()
