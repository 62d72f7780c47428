"""Annotation files cut at any byte: the same objects as from whole files."""

import glob
import json
import os
import random
import time

import pytest
from pyspark.errors import PySparkException

from tilewright.plans import q_sources
from tilewright.session import shared_root, stored
from tilewright.sources import annotations, splits


@pytest.fixture
def small_splits(spark):
    """A task reads about 300 bytes, so every file has many splits."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NAMES = ["Glomerulus", 'quoted "name"', "brace } in { it ]", "back\\slash\\", "é ü 中", "", None, "features", '"features": [']


def feature(draw):
    ring = [[round(draw.uniform(0, 9e4), draw.choice([0, 3])), float(draw.randrange(9))] for _ in range(draw.choice([1, 3, 3, 40]))]
    shape = draw.choice([[ring], [ring], [[ring]]])
    out = {"type": "Feature", "id": draw.choice(["a}b", 7]), "geometry": {"type": "Polygon", "coordinates": shape}}
    if draw.random() < 0.9:
        out["properties"] = {"extra": {"k": [{"z": 1}, "}"]}, "classification": {"name": draw.choice(NAMES), "colorRGB": -1}}
    return dict(draw.sample(list(out.items()), len(out)))


def collection(draw, features):
    out = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x}[", "more": {"a": "b"}}}, "features": features}
    return dict(draw.sample(list(out.items()), 3))


def rows(df):
    return sorted((r.slide, r.obj, r.class_name or "", [(p.x, p.y) for p in r.vertices]) for r in df.collect())


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_equals_whole_files(spark, tmp_path, small_splits):
    draw = random.Random(6)
    for k in range(24):
        features = [feature(draw) for _ in range(draw.choice([0, 1, 2, 30]))]
        whole = features if k % 2 else collection(draw, features)
        text = json.dumps(whole, indent=draw.choice([None, 0, 3]), ensure_ascii=draw.random() < 0.5)
        put(f"{tmp_path}/f{k}.json", draw.choice(["", " \n"]) + text + draw.choice(["", "\n", "  "]))
    got = annotations.annotation_objects(spark, str(tmp_path), split=True)
    want = rows(annotations.annotation_objects(spark, str(tmp_path)))
    assert rows(got) == want and len(want) > 100
    read = spark.read.option("lineSep", "}").text(str(tmp_path), pathGlobFilter="*.json")
    assert read.rdd.getNumPartitions() > 50


def test_gson(spark, tmp_path, small_splits):
    draw = random.Random(2)
    for k in range(6):
        features = [{"geometry": {"coordinates": [[[draw.randrange(9), 1.5], [2, 3], [4, 5]]]}, "properties": {"classification": {"name": f"n/{k}"}}} for _ in range(9 * k)]
        put(f"{tmp_path}/s{k}.mrxs.gson", "\x01junk \\[" + json.dumps(features)[1:] + "\n" * (k % 2))
    got = rows(annotations.annotation_objects(spark, str(tmp_path), "*.gson", split=True))
    assert got == rows(annotations.annotation_objects(spark, str(tmp_path), "*.gson")) and len(got) == 9 * 15


def test_rectangles(spark, tmp_path, small_splits):
    rect = lambda k: {"geometry": {"coordinates": [[[k, 0], [k, 50], [k + 9, 50], [k + 9, 0], [k, 0]][: 5 - (k % 7 == 6)]]}}
    put(f"{tmp_path}/s.geojson", json.dumps({"type": "FeatureCollection", "features": [rect(k) for k in range(60)]}))
    key = lambda df: sorted((r.slide, r.sample_n, r.x0, r.y0, r.x1, r.y1, r.w, r.h, r.valid) for r in df.collect())
    assert key(annotations.sample_rects(spark, str(tmp_path), split=True)) == key(annotations.sample_rects(spark, str(tmp_path)))


def test_a_file_that_ends_early_is_an_error_or_passed_over(spark, tmp_path, small_splits):
    text = json.dumps({"features": [{"geometry": {"coordinates": [[[1, 2], [3, 4], [5, 6]]]}, "properties": {"classification": {"name": "G"}}} for _ in range(40)]})
    put(f"{tmp_path}/ok/good.json", text)
    for k, cut in enumerate((1, 2, 3, 4, 20, 61, 200)):
        put(f"{tmp_path}/bad{k}/bad.json", text[:-cut] + "\n" * (k % 2))
        with pytest.raises(PySparkException, match="unreadable annotation"):
            annotations.annotation_objects(spark, f"{tmp_path}/bad{k}", split=True).collect()
        both = annotations.annotation_objects(spark, f"{tmp_path}/{{ok,bad{k}}}", split=True, strict=False)
        assert {r.slide for r in both.collect()} == {"good"}
    put(f"{tmp_path}/none/none.json", "[]")
    put(f"{tmp_path}/none/bom.json", "﻿" + text)
    assert {(r.slide, r.obj) for r in annotations.annotation_objects(spark, f"{tmp_path}/none", split=True).collect()} == {("bom", k) for k in range(40)}


def test_a_large_collection_is_read_by_several_tasks(spark, tmp_path):
    """30 MB on splits of 4 MB."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[k, k + 1] for k in range(100)]]}, "properties": {"classification": {"name": "G"}}})
    put(f"{tmp_path}/large.json", '{"type": "FeatureCollection", "features": [' + ", ".join([one] * 30_000) + "]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        found = splits.listed_objects(spark, f"{tmp_path}/large.json")
        assert found.selectExpr("count(*)", "count(distinct n)", "max(n)", "count(distinct text)").first() == (30_000, 30_000, 29_999, 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_collections_of_the_query_are_one_file_each(spark, sf):
    """A join on the collection that turns out to be a broadcast join, whose shuffle is then read by mapper, leaves one file each."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, value in conf.items():
            spark.conf.set(k, value)
        found = q_sources.s3_split_files(spark, sf)
        assert found.groupBy("part").count().count() == 4
        assert found.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def kept(spark):
    """(folders, bytes) of the intermediate tables there are."""
    root = shared_root(spark).removeprefix("file:")
    files = [f for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f)]
    return set(glob.glob(f"{root}/*")), sum(map(os.path.getsize, files))


def test_texts_of_large_files_are_not_kept(spark, tmp_path):
    """6 MB on splits of 1 MB: only what stands at the ends of the splits is written, and the texts are not shuffled."""
    draw = random.Random(4)
    one = lambda: {"geometry": {"coordinates": [[[draw.randrange(10**6), draw.randrange(10**6)] for _ in range(100)]]}, "properties": {"classification": {"name": "G"}}}
    features = [one() for _ in range(4_000)]
    put(f"{tmp_path}/large.json", json.dumps({"features": features}))
    before, conf = kept(spark)[1], "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(conf)
    spark.conf.set(conf, str(1 << 20))
    try:
        found = splits.listed_objects(spark, f"{tmp_path}/large.json")
        texts = {r.n: json.loads(r.text) for r in found.collect()}
    finally:
        spark.conf.set(conf, usual)
    assert texts == dict(enumerate(features))
    assert kept(spark)[1] - before < os.path.getsize(f"{tmp_path}/large.json") / 20


def test_escapes_and_quotes_at_the_ends_of_splits(spark, tmp_path, small_splits):
    """Backslashes in runs, quotes and brackets in names, beside names that cut a split in a string."""
    names = ["\\" * k + '"{[' * (k % 3) + "]}" * (k % 2) + "x" * (k * 7 % 90) for k in range(60)]
    put(f"{tmp_path}/s.json", json.dumps([{"geometry": {"coordinates": [[[1, 2], [3, 4], [5, k]]]}, "properties": {"classification": {"name": n}}} for k, n in enumerate(names)]))
    got = annotations.annotation_objects(spark, str(tmp_path), split=True).collect()
    assert {r.obj: r.class_name for r in got} == dict(enumerate(names)) and len(got) == 60


def test_collections_of_the_query_go_once_they_are_read(spark, sf):
    before = kept(spark)[0]
    found = q_sources.s3_split_files(spark, sf)
    assert not [f for f in kept(spark)[0] - before if os.path.basename(f).startswith("collections")]
    assert found.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_shuffle_files_of_a_stored_table_go(spark):
    """And the setting that was there stays."""
    name, store = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    shuffles = lambda: store.diskBlockManager().getAllFiles().size()
    usual, before = spark.conf.get(name, None), shuffles()
    table = stored(spark.range(1000).repartition(16, "id").groupBy("id").count(), "counts")
    deadline = time.time() + 20
    while shuffles() > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffles() <= before and table.count() == 1000 and spark.conf.get(name, None) == usual
