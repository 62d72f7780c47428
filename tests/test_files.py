"""Readers, writers and streams on files the tests write themselves."""

import json
import os

from pyspark.sql import functions as F

from tilewright.plans import q_models
from tilewright.plans import views as v
from tilewright.sources import annotations, files, listing
from tilewright.streaming import labels as label_stream
from tilewright.streaming import runs as run_stream


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_manifest(spark, tmp_path):
    for fold in ("train", "test"):
        put(f"{tmp_path}/tiles/{fold}/images/S1_PAS_sample0_3_4.png", "12345")
        put(f"{tmp_path}/tiles/{fold}/labels/S1_PAS_sample0_3_4.txt", "0 1 1 1 1")
    put(f"{tmp_path}/wsi/val/images/S2_PAS.tif", "1")
    got = {(r.level, r.fold, r.kind, r.ext, r.size, r.slide, r.tile_i, r.tile_j) for r in files.dataset_manifest(spark, str(tmp_path)).collect()}
    # All folds are listed; leaving the test fold out is `not_test`'s business.
    tile = [("tiles", fold, *rest) for fold in ("train", "test") for rest in (("images", "png", 5, "S1_PAS", 3, 4), ("labels", "txt", 9, "S1_PAS", 3, 4))]
    assert got == {*tile, ("wsi", "val", "images", "tif", 1, "S2_PAS", None, None)}
    plan = files.dataset_manifest(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_label_files(spark, tmp_path):
    put(f"{tmp_path}/a.txt", "0 0.5 0.5 0.2 0.4\n12 0.4 0.3 0.6 0.3 0.6 0.7 0.4 0.7\n\n")
    put(f"{tmp_path}/b.txt", "1 0.1 0.1 0.3 0.1 0.2 0.4")
    rows = files.label_rows(spark, str(tmp_path))
    assert {(r.name, r.line_n, r["class"], len(r.numbers)) for r in rows.collect()} == {("a", 0, 0, 4), ("a", 1, 12, 8), ("b", 0, 1, 6)}
    b = files.boxes_of_lines(rows).filter("name = 'b'").first()
    assert [round(v, 9) for v in (b.xc, b.yc, b.w, b.h)] == [0.2, 0.25, 0.2, 0.3]


def feature(ring, name):
    return {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"classification": {"name": name}}}


RING = [[1, 2], [3.5, 4], [5, 6]]


def test_annotations(spark, tmp_path):
    put(f"{tmp_path}/a.json", json.dumps({"type": "FeatureCollection", "features": [feature(RING, "G"), feature([RING], "H")]}))
    put(f"{tmp_path}/b.json", json.dumps([feature(RING, "G"), {"geometry": {"coordinates": [RING]}, "properties": {}}]))
    put(f"{tmp_path}/c.mrxs.gson", "\x01junk \\[" + json.dumps([feature(RING, "G")])[1:])
    put(f"{tmp_path}/d.json", "[]")
    points = [(1.0, 2.0), (3.5, 4.0), (5.0, 6.0)]
    read = lambda glob: sorted(
        (r.slide, r.obj, r.class_name or "", [(p.x, p.y) for p in r.vertices]) for r in annotations.annotation_objects(spark, str(tmp_path), glob).collect()
    )
    assert read("*.json") == [("a", 0, "G", points), ("a", 1, "H", points), ("b", 0, "G", points), ("b", 1, "", points)]
    assert read("*.gson") == [("c", 0, "G", points)]


def test_sample_annotations_and_rects(spark, tmp_path):
    text = json.dumps({"features": [{"coordinates": RING, "classification": "G"}]})
    got = annotations.sample_objects(spark.createDataFrame([("s", text)], "k string, t string"), "t", "k").first()
    assert (got.obj, got.class_name, len(got.vertices)) == (0, "G", 3)
    rect = lambda *v: {"geometry": {"coordinates": [list(v)]}}
    good = rect([0, 0], [0, 50], [100, 50], [100, 0], [0, 0])
    put(f"{tmp_path}/s.geojson", json.dumps({"features": [good, rect([0, 0], [0, 1], [0, 0]), rect([9, 9], [0, 0], [9, 20], [0, 0], [9, 9])]}))
    rows = {r.sample_n: r for r in annotations.sample_rects(spark, str(tmp_path)).collect()}
    assert (rows[0].w, rows[0].h, rows[0].valid) == (100, 50, True) and not rows[1].valid and not rows[2].valid


def test_training_metrics_and_patients(spark, tmp_path):
    put(f"{tmp_path}/runs/exp1/results.csv", "   epoch,  metrics/precision,metrics/recall\n 0, 0.5, 0.25\n 1, 0.75, 0.5\n")
    put(f"{tmp_path}/runs/exp2/results.csv", "   epoch,  metrics/precision,metrics/recall\n 0, 0.1, 0.2\n")
    m = files.training_metrics(spark, f"{tmp_path}/runs")
    assert m.columns == ["exp", "epoch", "metrics/precision", "metrics/recall"]
    assert sorted(map(tuple, m.collect())) == [("exp1", 0.0, 0.5, 0.25), ("exp1", 1.0, 0.75, 0.5), ("exp2", 0.0, 0.1, 0.2)]
    put(f"{tmp_path}/patients.csv", ",sex_f,age,label\n104800,1,59,2\n")
    assert files.clinical_table(spark, f"{tmp_path}/patients.csv").first().asDict() == {"id": 104800, "sex_f": 1.0, "age": 59.0, "label": 2}


def test_labels_stream_reads_each_file_once(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    ingest = lambda: label_stream.ingest(label_stream.label_files(spark, src), "value", "name", out, state)
    put(f"{src}/a.txt", "x\ny\nx")
    ingest()
    put(f"{src}/b.txt", "x\nx")
    ingest()
    got = sorted((r.name, r.line, r.pos) for r in label_stream.ingested(spark, out).collect())
    assert got == [("a", "x", 0), ("a", "y", 1), ("b", "x", 0)]


LOG = "exp int, event_id int, ts timestamp, status string, value double"


def log(spark, rows):
    return spark.createDataFrame(rows, "exp int, event_id int, ts string, status string").select(
        "exp", "event_id", F.to_timestamp("ts").alias("ts"), "status", F.lit(0.0).alias("value")
    )


def test_run_status_stream_follows_arriving_files(spark, tmp_path):
    log(spark, [(1, 1, "2024-01-01 00:00:00", "started"), (2, 2, "2024-01-01 00:00:00", "started")]).write.parquet(f"{tmp_path}/f1")
    log(spark, [(1, 3, "2024-01-01 05:00:00", "completed")]).write.parquet(f"{tmp_path}/f2")
    got = run_stream.run_status_table(spark, f"{tmp_path}/f*", LOG, lambda df: df).collect()
    assert {(r.exp, r.status) for r in got} == {(1, "completed"), (2, "started")}


def test_late_rows_do_not_reach_closed_windows(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    batches = [[(1, 1, "2024-01-01 10:00:00", "a")], [(1, 2, "2024-01-05 00:00:00", "a")],
               [(1, 3, "2024-01-01 11:00:00", "a"), (1, 4, "2024-01-09 00:00:00", "a")]]
    for n, rows in enumerate(batches):
        log(spark, rows).coalesce(1).write.mode("append").parquet(src)
        counts = run_stream.status_counts(run_stream.run_log(spark, src, LOG))
        q = counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
        q.trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.start)[:10], r.n) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01", 1), ("2024-01-05", 1)}


def test_late_entries_are_counted_however_files_arrive(spark, tmp_path):
    """300 files, the newest first and a hundred a batch: what came too late is told apart, and nothing is lost."""
    src = f"{tmp_path}/in"
    at = lambda k: f"2024-01-{1 + k // 10:02d} {k % 10 * 2:02d}:30:00"
    rows = [(k % 5, k, at(k), "ab"[k % 2]) for k in range(300)]
    log(spark, rows).repartitionByRange(300, "event_id").write.parquet(f"{tmp_path}/made")
    put(f"{src}/_ignored", "")
    made = sorted(f for f in os.listdir(f"{tmp_path}/made") if f.startswith("part"))
    assert len(made) == 300
    for k, f in enumerate(made):
        os.rename(f"{tmp_path}/made/{f}", f"{src}/{f}")
        os.utime(f"{src}/{f}", (1_700_000_000 - k, 1_700_000_000 - k))
    got = {(str(r.start)[:10], r.status): (r.n, r.n_late) for r in run_stream.status_count_table(spark, src, LOG, lambda df: df).collect()}
    # Batches of a hundred files, ten days each: the first is on time, all of the others came after their windows closed.
    days = {f"2024-01-{d:02d}" for d in range(1, 31)}
    closed = {d for d in days if d <= "2024-01-28"}
    assert got == {(d, s): ((5, 0) if d > "2024-01-20" else (0, 5)) for d in closed for s in "ab"}


def test_a_ledger_of_nothing_and_of_entries_without_a_time(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    log(spark, []).write.parquet(src)
    count = lambda: run_stream.count_arrivals(run_stream.run_log(spark, src, LOG), out, state)
    count()
    assert run_stream.arrival_counts(spark, out).count() == 0
    for rows in ([(1, 1, None, "a"), (1, 2, "2024-01-09 00:00:00", "a")], [(1, 3, None, "a"), (1, 4, "2024-01-01 00:00:00", "a")]):
        log(spark, rows).coalesce(1).write.mode("append").parquet(src)
        count()
    got = {(r.start and str(r.start)[:10], r.n, r.n_late, r.closed) for r in run_stream.arrival_counts(spark, out).collect()}
    assert got == {(None, 2, 0, False), ("2024-01-09", 1, 0, False), ("2024-01-01", 0, 1, True)}


def test_listing_is_dealt_to_tasks(spark, tmp_path):
    for level in ("wsi", "tiles"):
        for fold in ("train", "val", "test"):
            for k in range(4):
                put(f"{tmp_path}/{level}/{fold}/images/deep{k % 2}/S{k}_PAS.a b%20é.tif", "x" * (k + 1))
                put(f"{tmp_path}/{level}/{fold}/labels/S{k}.txt", "y" * 10 * k)
    put(f"{tmp_path}/wsi/train/labels/_SUCCESS", "no")
    put(f"{tmp_path}/wsi/train/labels/.hidden.txt", "no")
    put(f"{tmp_path}/top.txt", "12")
    found = listing.tree_files(spark, str(tmp_path))
    want = {(str(f.relative_to(tmp_path)), f.stat().st_size) for f in tmp_path.rglob("*") if f.is_file() and f.name[0] not in "._"}
    got = found.collect()
    assert {(r.path.split(f"{tmp_path}/")[1], r.length) for r in got} == want and len(got) == len(want) == 49
    assert found.rdd.getNumPartitions() >= 12
    rows = files.dataset_manifest(spark, str(tmp_path), "S?.t*t").groupBy("level", "fold", "kind").agg(F.sum("size").alias("n")).collect()
    assert {(r.level, r.fold, r.kind, r.n) for r in rows} == {(a, b, "labels", 60) for a in ("wsi", "tiles") for b in ("train", "val", "test")}
    assert listing.tree_files(spark, f"{tmp_path}/nothing").count() == 0


def test_listing_where_only_hadoop_knows_the_scheme(spark, tmp_path):
    put(f"{tmp_path}/tiles/train/labels/S1.txt", "12345")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./in", f"file://{tmp_path}")
    assert not listing.listed_by_tasks("viewfs://trees/in")
    assert [(r.fold, r.size) for r in files.dataset_manifest(spark, "viewfs://trees/in").collect()] == [("train", 5)]


def test_labels_delivered_again(spark, tmp_path):
    """Under another path, in one batch with the first delivery, with lines added, and after a restart."""
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    ingest = lambda: label_stream.ingest(label_stream.label_files(spark, src), "value", "name", out, state)
    put(f"{src}/one/a.txt", "x\ny\nx")
    put(f"{src}/two/a.txt", "x\ny\nx")
    ingest()
    put(f"{src}/three/a.txt", "x\ny\nx\nz\nz")
    put(f"{src}/three/b.txt", "y\n\ny")
    ingest()
    ingest()
    put(f"{src}/four/b.txt", "y\n\ny")
    ingest()
    got = sorted((r.name, r.line, r.pos) for r in label_stream.ingested(spark, out).collect())
    assert got == [("a", "x", 0), ("a", "y", 1), ("a", "z", 3), ("b", "", 1), ("b", "y", 0)]
    assert spark.conf.get(label_stream.STORE, None) != label_stream.ROCKSDB
    assert any("rocksdb" in n or n.endswith(".zip") for _, _, names in os.walk(f"{state}/state") for n in names)


def test_state_is_kept_for_a_time_only(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for k in range(3):
        put(f"{src}/{k}/a.txt", "x\ny")
        label_stream.ingest(label_stream.label_files(spark, src), "value", "name", out, state, within="0 seconds")
    assert label_stream.ingested(spark, out).count() == 6


def test_documents_of_the_flow_are_small_and_whole(spark, sf, monkeypatch):
    """Each slide's objects in order, in files of less than a quarter of the texts."""
    paths, write = [], annotations.write_annotation_lines
    monkeypatch.setattr(annotations, "write_annotation_lines", lambda df, path, *given: paths.append(path) or write(df, path, *given))
    q_models.flow_tile_dataset(spark, sf)
    documents = {r.slide: r.text for r in annotations.annotation_lines(spark, paths[0]).collect()}
    one = annotations.annotation_text(F.col("vertices"), q_models.class_text())
    want = {}
    for r in v.objects(spark, sf).select("slide", "tile", "obj", one.alias("feature")).orderBy("slide", "tile", "obj").collect():
        want.setdefault(str(r.slide), []).append(r.feature)
    assert documents == {k: '{"type":"FeatureCollection","features":[' + ",".join(f) + "]}" for k, f in want.items()}
    path = paths[0].removeprefix("file:")
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < sum(map(len, documents.values())) / 4
