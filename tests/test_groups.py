"""Row groups: ten positions open ten groups at most, and a tail leaves the early groups closed."""

import pytest
from pyspark.sql import functions as F

from barloom.sources import groups


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("groups") / "t")
    rows = spark.range(20_000).select("id", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), F.rand(1).alias("x"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 20_000).parquet(path)
    return path, groups.footers(spark, path).cache()


def test_positions_open_few_groups(spark, table, monkeypatch):
    path, found = table
    assert found.count() > 20 and found.agg(F.sum("rows")).first()[0] == 20_000
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 5, 777, 778, 9_999, 10_000, 15_555, 19_998, 19_999, 19_999)], "position bigint")
    opened = groups.wanted_groups(found, wanted)
    assert opened.count() <= 10
    assert {r.id for r in groups.rows_at(spark, path, wanted, found, ["id"]).collect()} == {0, 1, 5, 777, 778, 9_999, 10_000, 15_555, 19_998, 19_999}
    assert groups.rows_at(spark, path, wanted.limit(0), found, ["id", "x"]).count() == 0
    assert groups.rows_at(spark, path, spark.createDataFrame([(20_000,), (-1,)], "position bigint"), found, ["id"]).count() == 0


def test_tail_leaves_early_groups_closed(spark, table):
    path, found = table
    got = groups.tail(spark, path, 300, found, ["ts", "id"])
    assert sorted(r.id for r in got.collect()) == list(range(19_700, 20_000))
    bound = groups.tail_bound(found, 300)
    assert found.where(F.col("high") >= bound).count() < found.count() / 3
    assert groups.tail_bound(found, 30_000) is None and groups.tail(spark, path, 30_000, found, ["ts", "id"]).count() == 20_000
