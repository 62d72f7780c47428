"""Quirks and invariants on hand-made tables."""

import re

import pytest
from pyspark.sql import functions as F

from tilewright.functions import classes as cl
from tilewright.operators import folds, labels, matching, merging, metrics, pairing, pooling, runs, scoring, tiling
from tilewright.plans import jobs


def truth(spark, rows):
    return spark.createDataFrame(rows, "tile int, obj int, class int, x0 double, y0 double, w double, h double")


def preds(spark, rows):
    return spark.createDataFrame(rows, "tile int, pred int, x0 double, y0 double, w double, h double")


@pytest.mark.parametrize("cell", [16, 512])
def test_matching(spark, cell):
    t = truth(spark, [(1, 1, 0, 0.0, 0.0, 100.0, 100.0), (1, 2, 1, 50.0, 0.0, 100.0, 100.0), (1, 3, 2, 600.0, 600.0, 20.0, 20.0)])
    p = preds(spark, [
        (1, 1, 65.0, 45.0, 10.0, 10.0),    # centre (70, 50): both hold it, box 1 (20 px off) beats box 2 (30 px off)
        (1, 2, 70.0, 45.0, 10.0, 10.0),    # centre (75, 50): a tie, the smaller object number wins
        (1, 3, 145.0, 95.0, 10.0, 10.0),   # centre (150, 100): on the border of box 2
        (1, 4, 300.0, 300.0, 10.0, 10.0),  # nowhere
        (2, 5, 0.0, 0.0, 10.0, 10.0),      # tile without truth
    ])
    got = {r.pred: (r.obj, r["class"], r.n_matches) for r in matching.match_predictions(p, t, 2048, cell=cell).collect()}
    assert got == {1: (1, 0, 2), 2: (1, 0, 2), 3: (2, 1, 1), 4: (None, None, 0), 5: (None, None, 0)}


@pytest.mark.parametrize("cell", [7, 64, 512])
def test_overlap_needs_a_quarter_of_the_prediction(spark, cell):
    t = truth(spark, [(1, 1, 0, 0.0, 0.0, 50.0, 100.0), (1, 2, 1, 60.0, 0.0, 40.0, 100.0)])
    p = preds(spark, [(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 40.0, 0.0, 60.0, 100.0), (1, 3, 0.0, 76.0, 40.0, 96.0)])
    got = {r.pred: (r.n_matches, r.obj) for r in matching.overlap_match(p, t, 2048, cell=cell).collect()}
    assert got == {1: (2, 1), 2: (1, 2), 3: (1, 1)}


def test_refined_classes(spark):
    base = truth(spark, [(1, 1, 0, 0.0, 0.0, 100.0, 100.0), (1, 2, 0, 500.0, 500.0, 50.0, 50.0), (1, 3, 0, 800.0, 0.0, 90.0, 90.0)])
    fine = base.union(truth(spark, [(1, 4, 1, 10.0, 10.0, 20.0, 20.0), (1, 5, 1, 40.0, 40.0, 20.0, 20.0),
                                    (1, 6, 1, 810.0, 10.0, 10.0, 10.0), (1, 7, 2, 830.0, 10.0, 10.0, 10.0)]))
    got = {r.obj: (r.n_found, r.refined, r.conflict) for r in matching.refine_class(base, fine, 2048).collect()}
    assert got == {1: (2, 1, False), 2: (0, 0, False), 3: (2, None, True)}


def test_scores(spark):
    ids = {"Glomerulus": 0, "Cellular Crescent": 1, "FibrousCrescent": 2}
    rows = [("focal", 0)] * 3 + [("focal", 1)] + [("cres", 1)] * 3 + [("cres", 0)] + [("scler", 2)] * 3 + [("scler", 0)]
    rows += [("even", 0), ("even", 1)] + [("fp", 3)]
    df = spark.createDataFrame(rows, "slide string, class int")
    score = lambda **o: {r.slide: r.berden for r in scoring.berden_scores(df, ["slide"], ids, **o).collect()}
    assert score() == {"focal": "Focal", "cres": "Crescentic", "scler": "Sclerotic", "even": "Sclerotic"}
    assert score(mixed_rule=True)["even"] == "Mixed"


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "truth int, predicted int")
    m = metrics.macro_metrics(df).first()
    assert m.accuracy == pytest.approx(4 / 6) and m.precision == pytest.approx((1 + 1 / 3 + 1) / 3)
    assert m.recall == pytest.approx((1 / 2 + 1 + 2 / 3) / 3)
    cm = {(r.truth, r.predicted): r.share for r in metrics.confusion_matrix(df, 3).collect()}
    assert len(cm) == 9 and cm[2, 1] == pytest.approx(1 / 6) and cm[1, 2] == 0 and sum(cm.values()) == pytest.approx(1)


def test_short_last_batch_weighs_the_same(spark):
    df = spark.range(10).select("id", F.lit(1).alias("truth"), F.lit(1).alias("predicted"))
    row = metrics.batch_mean_accuracy(df, "id", 4).first()
    assert (row.n_batches, row.accuracy) == (3, 1.0)


def test_checks(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.8, 0.2],), ([0.5, 0.2],), ([1.0],)], "r array<double>")
    assert [r[0] for r in df.select(labels.bad_ratio(F.col("r"))).collect()] == [False, False, True, True]
    maps = spark.createDataFrame([({"a": 0, "b": 1},), ({"a": 1, "b": 2},), ({"a": 0, "b": 0},)], "m map<string,int>")
    assert [r[0] for r in maps.select(labels.not_zero_indexed(F.col("m"))).collect()] == [False, True, True]
    bags = spark.createDataFrame([("b1", "s1"), ("b1", "s2"), ("b2", "s1")], "bag string, slide string")
    assert [r.bag for r in pairing.mixed_bags(bags).collect()] == ["b1"]
    with pytest.raises(ValueError):
        labels.merge_classes(df, 1, 1)


def test_merging_keeps_the_first_file_and_the_second_dims(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "file string, n int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "file string, n int")
    assert sorted(map(tuple, merging.merge_datasets(a, b, ["file"]).collect())) == [("x", 1), ("y", 1), ("z", 2)]
    assert sorted(map(tuple, merging.merge_dims(a, b, "file", ["n"]).collect())) == [("x", 1), ("y", 2), ("z", 2)]
    assert merging.merge_gap(a, b, merging.merge_datasets(a, b, ["file"])).first().ok


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "val"), ("c", "train"), ("c", "val")], "k string, fold string")
    assert [tuple(r) for r in folds.leaks(df, "k").collect()] == [("c", 1, 1)]


def test_status_is_the_latest_and_short_trainings_are_named(spark):
    log = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "started"), (1, 2, "2024-01-01 02:00:00", "completed"),
                                 (2, 3, "2024-01-01 00:00:00", "a"), (2, 4, "2024-01-01 00:00:00", "b")],
                                "exp int, event_id int, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.exp: (r.status, r.seconds) for r in runs.run_status(log).collect()}
    assert got == {1: ("completed", 7200), 2: ("b", 0)}
    s = spark.createDataFrame([(59,), (60,), (7200,)], "s int").select(runs.training_status(F.col("s")))
    assert [r[0] for r in s.collect()] == ["<1min", "completed", "completed"]


def test_pooling_of_one_instance_is_the_instance(spark):
    df = spark.createDataFrame([("b", 1, [1.0, -2.0])], "bag string, instance int, embedding array<float>")
    assert pooling.attention(df, [3.0, 1.0]).first().pooled == pytest.approx([1.0, -2.0])
    assert pooling.softmax_mean(df).first().pooled == pytest.approx([1.0, -2.0])


def test_pooling_survives_large_scores(spark):
    df = spark.createDataFrame([("b", 1, [900.0, 0.0]), ("b", 2, [1000.0, 0.0])], "bag string, instance int, embedding array<float>")
    assert pooling.attention(df, [1.0, 0.0]).first().pooled == pytest.approx([1000.0, 0.0])
    assert pooling.softmax_mean(df).first().pooled == pytest.approx([1000.0, 0.0])


def test_colours_and_scores(spark):
    df = spark.createDataFrame([(0, 255, 0), (255, 0, 0), (9, 9, 9)], "r int, g int, b int")
    assert [r[0] for r in df.select(cl.colour_class(F.col("r"), F.col("g"), F.col("b"))).collect()] == [0, 1, None]
    s = spark.createDataFrame([([0.1, 0.7, 0.7],)], "s array<double>").select(cl.best_class(F.col("s")))
    assert s.first()[0] == 1


def test_default_rect_and_tissue(spark):
    slides = spark.createDataFrame([("a", 500, 400), ("b", 500, 400)], "slide string, w int, h int")
    rects = spark.createDataFrame([("a", 0, 0, 0, 100, 100), ("a", 1, 50, 50, 200, 200)], "slide string, sample_n int, x0 int, y0 int, x1 int, y1 int")
    regions = tiling.with_default_rect(slides, rects)
    assert {tuple(r) for r in regions.filter("slide = 'b'").collect()} == {("b", 0, 0, 0, 500, 400)}
    ring = [{"x": 80, "y": 80}, {"x": 120, "y": 80}, {"x": 120, "y": 120}, {"x": 80, "y": 120}]
    objects = spark.createDataFrame([("a", 1, None, ring), ("a", 2, "Tissue", ring), ("b", 3, "G", ring)],
                                    "slide string, obj int, class_name string, vertices array<struct<x:bigint,y:bigint>>")
    got = tiling.samples_of_objects(objects, regions).collect()
    # The centroid (100, 100) lies on the border of sample 0 and inside sample 1.
    assert sorted((r.slide, r.obj, r.sample_n, r.class_name) for r in got) == [("a", 1, 0, "Glo-NA"), ("a", 1, 1, "Glo-NA"), ("b", 3, 0, "G")]
    first = next(r for r in got if r.sample_n == 0 and r.slide == "a")
    assert [(p.x, p.y) for p in first.vertices] == [(80, 80), (100, 80), (100, 100), (80, 100)]


def test_cleaning_by_source(spark):
    tiles = spark.createDataFrame([(t, "test" if t == 9 else "train") for t in range(10)], "tile int, fold string")
    rows = [(0, 1, 0, 1), (0, 2, 0, 1), (1, 1, 1, 1), (2, 1, 2, 1), (3, 1, 3, 1), (9, 1, 0, 1), (77, 1, 0, 1)]
    df = spark.createDataFrame(rows, "tile int, obj int, class int, x0 int")
    seen = lambda source, **o: sorted((r.tile, r["class"], r.class_fine) for r in jobs.clean(source, tiles, df, ["class", "x0"], **o)[1].collect())
    held = (9, 0, 0)  # the test fold stays as it is
    assert seen("hubmap") == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3), held]
    assert sorted(seen("muw"), key=repr) == sorted([(0, 0, 0), (1, None, 1), (2, 1, 2), (3, None, 3), held], key=repr)
    assert sorted(seen("tcd", remove=(3, 0), ignore=(2,)), key=repr) == sorted([(1, 1, 1), (2, None, 2), held], key=repr)
    # 4 full tiles, 5 empty ones; one third of all tiles may be empty: 4 / (2/3) = 6, so 2 stay.
    kept = jobs.clean("hubmap", tiles, df, ["class", "x0"], empty_share=1 / 3)[0]
    assert kept.count() == 7 and kept.filter("tile = 9").count() == 1 and kept.filter("tile in (0, 1, 2, 3)").count() == 4
    with pytest.raises(ValueError):
        jobs.clean("other", tiles, df, ["class"])


def test_labelled_crops_with_finer_classes(spark):
    t = truth(spark, [(k, 1, 0, 0.0, 0.0, 100.0, 100.0) for k in range(30)])
    fine = t.union(truth(spark, [(k, 2, 1, 10.0, 10.0, 20.0, 20.0) for k in range(0, 30, 3)]))
    p = preds(spark, [(k, 1, 5.0, 5.0, 90.0, 90.0) for k in range(30)] + [(k, 2, 700.0, 700.0, 90.0, 90.0) for k in range(5)])
    out = jobs.label_crops(p, t, 2048, fine)
    assert {(r["class"], r["count"]) for r in out.groupBy("class").count().collect()} == {(0, 20), (1, 20), (3, 20)}
    assert {r["count"] for r in out.filter("fold = 'test'").groupBy("class").count().collect()} == {4}


def test_cells_grow_with_the_tile(spark):
    """Boxes are filed on a grid of as many cells whatever the tile's size, where both sides are boxes on a coarser one."""
    for tile in (2048, 4096):
        box = spark.range(3).selectExpr("id as tile", "id as obj", "id as pred", "id as class", "id as x0", "id as y0", "id as w", "id as h")
        plans = [f(box, box, tile)._jdf.queryExecution().analyzed().toString() for f in (matching.match_predictions, matching.overlap_match)]
        for plan, cell in zip(plans, (tile // 8, tile // 4)):
            assert set(re.findall(r"/ cast\((\d{3,}) as double\)|/ (\d{3,})\.0", plan)) in ({(str(cell), "")}, {("", str(cell))})
