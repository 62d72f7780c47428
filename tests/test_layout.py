"""Bucketed tables: same rows, no exchange, and the layout survives the session that wrote it."""

import pytest

from tilewright.operators import pairing
from tilewright.plans import views as v
from tilewright.plans.catalog import QUERIES
from tilewright.sources import files, layout


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_stored_tables", "j2_stored_tables", "j9_stored_tables"])
def test_joins_on_stored_tables_do_not_shuffle(spark, sf, no_broadcast, name):
    found = QUERIES[name](spark, sf)
    assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
    assert found.count() > 0


def test_full_tiles_on_reopened_tables(spark, sf, tmp_path, no_broadcast):
    tiles, labels = v.folded_tiles(spark, sf), v.labels(spark, sf)
    layout.write_bucketed(tiles, f"{tmp_path}/tiles", ["tile"], 4)
    files.write_split_dataset(labels.withColumn("fold", v.fold_of(labels["slide"])), f"{tmp_path}/labels", buckets=4)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t, b = layout.open_bucketed(other, f"{tmp_path}/tiles"), layout.open_bucketed(other, f"{tmp_path}/labels")
    found = pairing.full_tiles(t, b, ["tile"])
    assert "Exchange" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairing.full_tiles(tiles, labels, ["tile"]).collect()))
    # Plain readers see plain files, and one directory's rows only where a fold is asked for.
    assert other.read.parquet(f"{tmp_path}/labels").count() == labels.count()
    assert "PartitionFilters: [isnotnull(fold" in plan(b.filter("fold = 'train'"))


def test_fewer_buckets_still_meet(spark, tmp_path, no_broadcast):
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    try:
        a = layout.write_bucketed(spark.range(1000).selectExpr("id as tile", "id % 7 as n"), f"{tmp_path}/a", ["tile"], 8)
        b = layout.write_bucketed(spark.range(0, 1000, 3).selectExpr("id as tile"), f"{tmp_path}/b", ["tile"], 2)
        found = a.join(b, "tile")
        assert "Exchange" not in plan(found) and found.count() == 334
    finally:
        spark.conf.unset("spark.sql.bucketing.coalesceBucketsInJoin.enabled")


def test_bucket_numbers_and_empty_tables(spark, tmp_path):
    assert [layout.buckets_for(n, 10) for n in (0, 1, 10, 11, 20, 21, 1000)] == [1, 1, 1, 2, 2, 4, 128]
    t = layout.write_bucketed(spark.range(0).selectExpr("id as tile", "'a' as fold"), f"{tmp_path}/none", ["tile"], 4, ["fold"])
    assert t.count() == 0 and layout.open_bucketed(spark, f"{tmp_path}/none").count() == 0


def test_label_lines_in_buckets_read_as_before(spark, sf, tmp_path):
    rows = v.shares(v.boxes(spark, sf)).selectExpr("*", "case when slide % 10 = 0 then 'test' else 'train' end as fold")
    line = files.label_line(rows["class"], rows["xc"], rows["yc"], rows["w"], rows["h"])
    files.write_labels(rows, f"{tmp_path}/plain", line)
    files.write_labels(rows, f"{tmp_path}/dealt", line, buckets=4)
    read = lambda p: sorted(map(str, files.read_labels(spark, f"{tmp_path}/{p}").collect()))
    assert read("plain") == read("dealt")
