"""Tables switched by their manifest, and upserts by bucket."""

import pytest
from pyspark.sql import functions as F

from scorewright.session import new_path
from scorewright.sources import snapshots, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_failing_write_leaves_the_old_table(spark):
    path = new_path(spark, "snapshot")
    first = spark.createDataFrame([(1, "a"), (2, None)], "id int, `x.y` string")
    assert rows(snapshots.replace_snapshot(first, path)) == rows(first)
    broken = spark.range(4).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).alias("x.y"))
    with pytest.raises(Exception, match="no"):
        snapshots.replace_snapshot(broken, path)
    held = snapshots.read_snapshot(spark, path)
    assert rows(held) == rows(first)
    itself = snapshots.replace_snapshot(held.where("id = 1"), path)  # from itself
    assert rows(itself) == [(1, "a")] and rows(held) == rows(first)
    assert snapshots.vacuum(spark, path) == 2 and rows(snapshots.read_snapshot(spark, path)) == [(1, "a")]
    assert rows(tables.scan_table(spark, path, ["id"])) == [(1,)]
    assert snapshots.read_snapshot(spark, new_path(spark, "none")) is None


def test_upserts_touch_their_buckets_alone(spark):
    path, keys = new_path(spark, "bucketed"), ["a", "b"]
    old = spark.range(200).selectExpr("id as a", "cast(id % 7 as string) as b", "'old' as v", "0 as seq")
    nulls = spark.createDataFrame([(None, "n", "old", 0)], "a long, b string, v string, seq int")
    snapshots.upsert_snapshot(spark, path, old.unionByName(nulls), keys, ["seq"], buckets=16)
    before = snapshots.manifest(spark, path)["folders"]
    batch = spark.createDataFrame([(5, "5", "new", 1), (5, "5", "newer", 2), (None, "n", "new", 1), (900, "z", "new", 1)], old.unionByName(nulls).schema)
    got = snapshots.upsert_snapshot(spark, path, batch, keys, ["seq"])
    want = [r for r in rows(old) if r[0] != 5] + [(5, "5", "newer", 2), (None, "n", "new", 1), (900, "z", "new", 1)]
    assert rows(got) == sorted(want, key=str)
    after = snapshots.manifest(spark, path)["folders"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 3
    one = snapshots.upsert_snapshot(spark, path, batch.where("v = 'newer'"), keys, ["seq"])
    held = rows(got)
    assert sum(after.get(b) != f for b, f in snapshots.manifest(spark, path)["folders"].items()) == 1 and rows(one) == held
    assert snapshots.vacuum(spark, path) >= 1 and rows(snapshots.read_snapshot(spark, path)) == held
    assert rows(snapshots.upsert_snapshot(spark, path, batch.limit(0), keys, ["seq"])) == held
    with pytest.raises(ValueError, match="bucketed by"):
        snapshots.upsert_snapshot(spark, path, batch, ["a"], ["seq"])
