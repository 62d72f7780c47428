"""Inputs that must not vanish silently, and plans that must not shuffle more than they need."""

import pytest
from pyspark.errors import PySparkException

from tilewright import session
from tilewright.operators import labels as lb
from tilewright.operators import matching, pairing
from tilewright.plans import jobs
from tilewright.plans import views as v
from tilewright.plans.catalog import QUERIES
from tilewright.sources import annotations, files
from tilewright.streaming import labels as label_stream
from tilewright.streaming import runs as run_stream

GOOD = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,9],[9,9],[9,0],[0,0]]]},"properties":{"classification":{"name":"Glomerulus"}}}]}'


def test_unreadable_annotations_are_an_error_or_listed(spark):
    df = spark.createDataFrame([("a", GOOD), ("b", GOOD[:-30]), ("c", "no annotation")], "slide string, text string")
    with pytest.raises(PySparkException, match="unreadable annotation: b"):
        annotations.objects_of(df, "text", "slide").collect()
    with pytest.raises(PySparkException):
        annotations.rects_of(df.filter("slide <> 'c'"), "text").collect()
    assert [r["slide"] for r in annotations.objects_of(df, "text", "slide", strict=False).collect()] == ["a"]
    assert [tuple(r) for r in annotations.unreadable(df, "text", "slide").collect()] == [("b", "unreadable")]


def test_confidence_needs_a_registered_threshold(spark):
    preds = spark.createDataFrame([(0.9,)], "conf double")
    for task, classify in (("segmentation", True), ("unheard of", True)):
        with pytest.raises(ValueError):
            lb.by_confidence(preds, lb.model_registry(spark), "yolo", task, classify)
    assert lb.by_confidence(preds, lb.model_registry(spark), "yolo", "segmentation", False).count() == 1


def test_nulls_stay_or_are_reported(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 5)], "tile int, class int")
    assert sorted(r["tile"] for r in lb.drop_class(df, 0).collect()) == [2, 3]
    assert sorted(r["tile"] for r in lb.not_allowed(df, {"class": [0]}).collect()) == [2, 3]
    slides = spark.createDataFrame([(1, "train")], "slide int, fold string")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "slide int")
    assert sorted((str(r["slide"]), r["fold"]) for r in pairing.inherit_fold(rows, slides).collect()) == [("1", "train"), ("2", None), ("None", None)]
    assert sorted(str(r["slide"]) for r in pairing.unknown_slides(rows, slides).collect()) == ["2", "None"]


def test_metrics_by_column_name(spark, tmp_path):
    for exp, body in (("a", "epoch, precision,recall\n1,0.5,0.25\n"), ("b", "recall,epoch\n0.75,2\n"), ("c", "epoch,extra\r\n3, nan\r\n\n")):
        (tmp_path / exp).mkdir()
        (tmp_path / exp / "results.csv").write_text(body)
    rows = {r["exp"]: r.asDict() for r in files.training_metrics(spark, str(tmp_path)).collect()}
    assert rows["a"] == {"exp": "a", "epoch": 1.0, "precision": 0.5, "recall": 0.25, "extra": None}
    assert rows["b"] == {"exp": "b", "epoch": 2.0, "precision": None, "recall": 0.75, "extra": None}
    assert rows["c"]["epoch"] == 3.0 and rows["c"]["precision"] is None


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fields = "user_id bigint, event_id bigint, ts timestamp, event_type string, value double"
    assert run_stream.run_status_table(spark, str(tmp_path / "in"), fields, v.shape_runs).count() == 0
    out = str(tmp_path / "out")
    label_stream.ingest(label_stream.label_files(spark, str(tmp_path / "in")), "value", "name", out, str(tmp_path / "state"))
    assert label_stream.ingested(spark, out).count() == 0
    (tmp_path / "in" / "t1.txt").write_text("0 1 2\n0 1 2\n3 4 5")
    label_stream.ingest(label_stream.label_files(spark, str(tmp_path / "in")), "value", "name", out, str(tmp_path / "state"))
    assert sorted(map(tuple, label_stream.ingested(spark, out).select("name", "line", "pos").collect())) == [("t1", "0 1 2", 0), ("t1", "3 4 5", 2)]


def test_several_machines_need_a_shared_folder():
    assert session.single_machine("local[8]") and session.single_machine("local")
    assert not any(map(session.single_machine, ("local-cluster[3,2,1024]", "spark://host:7077", "yarn")))


def test_intermediates_can_be_discarded(spark):
    path = session.fresh_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.discard(spark) >= 1
    with pytest.raises(PySparkException):
        spark.read.parquet(path)


def test_matching_groups_in_the_partitions_of_its_join(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        preds, boxes = (f(spark, sf) for f in (v.preds, v.boxes))
        plan = matching.match_predictions(preds, boxes, v.TILE)._jdf.queryExecution().executedPlan().toString()
        assert "pred" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_boxes_are_clipped_to_the_tile(spark):
    box = lambda rows: spark.createDataFrame(rows, "tile int, obj int, pred int, class int, x0 double, y0 double, w double, h double")
    truth = box([(1, 1, 1, 0, -1e9, -1e9, 2e9, 2e9), (1, 2, 2, 1, 10.0, 10.0, 5.0, 5.0)])
    rows = matching.match_predictions(box([(1, 0, 7, 0, 10.0, 10.0, 4.0, 4.0)]), truth, 2048).collect()
    assert [(r["n_matches"], r["class"]) for r in rows] == [(2, 1)]
    assert matching.overlap_match(box([(1, 0, 7, 0, 10.0, 10.0, 4.0, 4.0)]), truth, 2048).collect()[0]["n_matches"] == 2


def test_main_flow_as_the_readme_shows_it(spark, tmp_path):
    (tmp_path / "S1_PAS.json").write_text(GOOD)
    classes = {"Glomerulus": 0}
    objects = annotations.annotation_objects(spark, str(tmp_path))
    slides = spark.createDataFrame([("S1_PAS", 4096, 4096)], "slide string, w int, h int")
    rects = spark.createDataFrame([], "slide string, sample_n int, x0 double, y0 double, x1 double, y1 double")
    folds = spark.createDataFrame([("S1_PAS", "train")], "slide string, fold string")
    assert jobs.unmapped_classes(objects, classes).isEmpty()
    assert jobs.unmapped_classes(objects, {"Other": 0}).collect()[0]["class_name"] == "Glomerulus"
    labels = jobs.build_labels(objects, slides, rects, 2048, 1024, classes=classes)
    tiles = jobs.tile_table(slides, rects, folds, 2048, 1024)
    assert tiles.count() == 9
    kept, cleaned = jobs.clean("tcd", tiles.select("tile", "fold"), labels, ["class", "xc", "yc", "w", "h"], empty_share=0.5)
    assert [(r["tile"], r["class"]) for r in cleaned.collect()] == [("S1_PAS_sample0_0_0", 0)]
    assert "S1_PAS_sample0_0_0" in {r["tile"] for r in kept.collect()}
    held = tiles.select("tile").selectExpr("tile", "'test' as fold")
    kept, cleaned = jobs.clean("tcd", held, labels, ["class", "xc", "yc", "w", "h"], remove=(0,))
    assert kept.count() == 9 and cleaned.count() == 1


def test_l7_has_work_at_every_size(spark):
    assert QUERIES["l7_pad_small_slides"](spark, "/root/testdata/sf0.1").count() > 0


def test_boxes_beyond_a_usual_tile(spark):
    """At 4096 pixels a box at (3000, 3000) matches; with a tile of 2048 it is listed as outside."""
    box = lambda rows: spark.createDataFrame(rows, "tile int, obj int, pred int, class int, x0 double, y0 double, w double, h double")
    truth, preds = box([(1, 1, 1, 2, 3000.0, 3000.0, 50.0, 50.0)]), box([(1, 0, 7, 0, 3005.0, 3005.0, 40.0, 40.0)])
    one = lambda df: df.select("n_matches", "class").collect()
    assert one(matching.match_predictions(preds, truth, 4096)) == [(1, 2)]
    assert one(matching.overlap_match(preds, truth, 4096)) == [(1, 2)]
    fine = box([(1, 5, 5, 1, 3010.0, 3010.0, 4.0, 4.0)])
    assert [(r["refined"], r["n_found"]) for r in matching.refine_class(truth, fine, 4096).collect()] == [(1, 1)]
    crops = jobs.label_crops(preds.select("tile", "pred", "x0", "y0", "w", "h"), truth, 4096).collect()
    assert {r["class"] for r in crops} == {2}
    assert matching.outside_tile(truth, 4096).isEmpty() and matching.outside_tile(truth, 2048).count() == 1
    odd = box([(1, 1, 1, 0, None, 1.0, 1.0, 1.0), (1, 2, 1, 0, -9.0, 0.0, 8.0, 8.0), (1, 3, 1, 0, -9.0, 0.0, 9.0, 8.0), (1, 4, 1, 0, 5.0, 5.0, -1.0, 2.0)])
    assert sorted(r["obj"] for r in matching.outside_tile(odd, 2048).collect()) == [1, 2, 4]
    with pytest.raises(TypeError):
        matching.match_predictions(preds, truth)
