"""Committed tables: untouched files stay, a write without its commit is not seen, and of two writers one wins."""

import pytest
from pyspark.sql import functions as F

from barloom.sources import committed

COLUMNS = ["id", "value"]


@pytest.fixture
def table(spark, tmp_path):
    made = committed.KeyedTable(spark, str(tmp_path / "t"), ["id"], COLUMNS, buckets=8)
    made.upsert(batch(spark, [(i, f"old {i}", 0) for i in range(60)]), "seq")
    return made


def batch(spark, rows):
    return spark.createDataFrame(rows, "id bigint, value string, seq bigint")


def values(df):
    return {r.id: r.value for r in df.collect()}


def test_untouched_buckets_keep_their_files(spark, table):
    before, old = table.manifest(), values(table.records())
    version = table.upsert(batch(spark, [(7, "first", 1), (7, "new 7", 2), (100, "new 100", 1)]), "seq")
    after = table.manifest()
    touched = set(map(str, after["facts"]["touched"]))
    assert version == 2 and 1 <= len(touched) <= 2
    assert all(after["parts"][b] == files for b, files in before["parts"].items() if b not in touched)
    assert all(set(after["parts"][b]).isdisjoint(before["parts"].get(b, [])) for b in touched)
    assert values(table.records()) == {**old, "7": "new 7", "100": "new 100"} and values(table.records(1)) == old


def test_keys_are_normalised(spark, table):
    texts = spark.createDataFrame([(" 7 ", "text", 1)], "id string, value string, seq bigint")
    table.upsert(texts, "seq")
    got = values(table.records())
    assert got[" 7 "] == "text" and "7" not in got and len(got) == 60


def test_a_crash_before_the_commit_leaves_the_old_version(spark, table, monkeypatch):
    old = values(table.records())
    monkeypatch.setattr(table, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(batch(spark, [(7, "never", 1)]), "seq")
    again = committed.KeyedTable(spark, table.path, ["id"], COLUMNS, buckets=8)
    assert again.version() == 1 and values(again.records()) == old


def test_one_of_two_writers_wins(spark, table):
    base = table.manifest()
    table.upsert(batch(spark, [(1, "a", 1)]), "seq")
    with pytest.raises(committed.Conflict):
        table.commit(base["version"], base["parts"], base["schemas"], {})
    assert values(table.records())["1"] == "a"


def test_empty_batches_and_tables(spark, tmp_path):
    table = committed.KeyedTable(spark, str(tmp_path / "e"), ["id"], COLUMNS)
    assert table.records().count() == 0 and table.upsert(batch(spark, []), "seq") == 0
    empty = batch(spark, []).withColumns({"symbol": F.lit("a"), "ts": F.current_timestamp()})
    facts = committed.write_dataset(empty, str(tmp_path / "d"), "seq")
    assert facts["rows"] == 0 and committed.read_dataset(spark, str(tmp_path / "d"))[0].count() == 0


def test_dataset_versions(spark, tmp_path, bars):
    path, df = str(tmp_path / "d"), spark.createDataFrame(bars).withColumn("y", F.lit(1))
    committed.write_dataset(df, path, "y", preview=5)
    committed.write_dataset(df.where("symbol = 'b'"), path, "y", preview=5)
    data, facts = committed.read_dataset(spark, path)
    assert facts["rows"] == data.count() == 37 == facts["positives"] and data.columns == df.columns
    tail = committed.read_dataset(spark, path, "tail")[0]
    last = bars[bars["symbol"] == "b"].sort_values("ts").tail(5)
    assert sorted(r.close for r in tail.collect()) == pytest.approx(sorted(last["close"]))
