"""All registered queries with expected SQL against DuckDB."""

import os

import pytest

from barloom.plans import REGISTRY
from compare import ROOT, compare, connect

SQL = [n for n, q in REGISTRY.items() if q.sql is not None]
SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return connect(SF)


@pytest.mark.parametrize("name", SQL)
def test_query(name, spark, con):
    ok, _, _, message = compare(REGISTRY[name], spark, con, SF)
    assert ok, message


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) > 5


def test_mixed_scan_writes_in_parts(spark, con):
    """No header shape goes through one task."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        files = REGISTRY["mixed_csv_scan"].frame(spark, SF).inputFiles()
        assert all(sum(f"/{n}/" in f for f in files) > 1 for n in "ab")
        ok, _, _, message = compare(REGISTRY["mixed_csv_scan"], spark, con, SF)
        assert ok, message
    finally:
        spark.conf.unset(key)
