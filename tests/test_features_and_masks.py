"""Saved feature vectors, and classes by the colour of a painted mask."""

import io
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tilewright.functions.classes import colour_class
from tilewright.operators import raster
from tilewright.plans import q_rows
from tilewright.sources import features


def saved(array, **options):
    out = io.BytesIO()
    np.lib.format.write_array(out, array, **options)
    return out.getvalue()


def test_saved_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = {f"crop{k}": rng.normal(size=k).astype(t) for k, t in enumerate(["<f4", "<f4", ">f4", "<f8", ">f8", "<f2", "<f4"])}
    for k, (name, values) in enumerate(made.items()):
        (tmp_path / f"d{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 2}" / f"{name}.npy").write_bytes(saved(values, version=(1 + k % 3, 0)))
    np.save(tmp_path / "plain.x", np.float32([1.5, -0.0, np.nan]))
    got = {r.instance: r.embedding for r in features.feature_files(spark, str(tmp_path)).collect()}
    assert set(got) == {*made, "plain"} and got["plain"][:2] == [1.5, 0.0]
    for name, values in made.items():
        assert got[name] == values.astype(np.float32).tolist()


def test_what_is_no_vector_is_an_error_or_null(spark):
    good = saved(np.float32([1, 2]))
    bad = [None, b"", b"\x93NUMPY", good[:-1], good + b"x", saved(np.float32([[1, 2]])), saved(np.int32([1])), b"x" * 200, saved(np.float32(3)), b"\x93NUMPY\x01\x00\x04\x00abcd"]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate([*bad, good])], "k int, content binary")
    rows = {r.k: r.embedding for r in features.vectors_of(df, "content", "k", strict=False).collect()}
    assert rows == {**{k: None for k in range(len(bad))}, len(bad): [1.0, 2.0]}
    for k in range(len(bad)):
        with pytest.raises(PySparkException, match="unreadable feature file"):
            features.vectors_of(df.filter(F.col("k") == k), "content", "k").collect()
    assert features.vectors_of(df.filter("k < 0"), "content", "k").count() == 0


def test_written_vectors(spark, tmp_path):
    df = spark.createDataFrame([(7, [1.0, 0.1]), (8, [])], "id int, v array<double>")
    features.write_feature_files(df, f"file://{tmp_path}/new/feats", "id", "v")
    assert np.load(tmp_path / "new" / "feats" / "7.npy").tolist() == np.float32([1.0, 0.1]).tolist()
    assert {r.instance: len(r.embedding) for r in features.feature_files(spark, f"{tmp_path}/new").collect()} == {"7": 2, "8": 0}


COLOURS = [(0, 255, 0), (255, 0, 0), (0, 0, 255), (9, 9, 9), None]


def test_colour_at_the_mean_of_the_vertices(spark):
    """Masks pixel by pixel: runs that touch, runs with gaps, and points on their ends."""
    draw = random.Random(8)
    masks = {t: [[draw.choice(COLOURS[: 2 + t]) if draw.random() < 0.3 or x == 0 else "same" for x in range(40)] for _ in range(12)] for t in range(4)}
    masks[3] = [[None] * 40 for _ in range(12)]
    cells = []
    for t, mask in masks.items():
        for y, row in enumerate(mask):
            for x, colour in enumerate(row):
                row[x] = row[x - 1] if colour == "same" else colour
                if row[x] is not None:
                    cells.append((t, x, y, *row[x]))
    runs = raster.run_rows(spark.createDataFrame(cells, "tile int, cell_x int, cell_y int, r int, g int, b int"), ["r", "g", "b"])
    assert sum(r.to_x - r.from_x + 1 for r in runs.collect()) == len(cells) and runs.count() < len(cells) / 2
    objects = []
    for k in range(600):
        ring = [(draw.uniform(-1, 42), draw.uniform(-1, 13)) for _ in range(draw.choice([1, 1, 2, 5]))]
        objects.append((k, draw.randrange(5), ring))
    objects += [(700, 0, [(39.999, 11.999)]), (701, 0, [(-0.5, 0.0)]), (702, 0, []), (703, None, [(1.0, 1.0)])]
    df = spark.createDataFrame(objects, "obj int, tile int, vertices array<struct<x: double, y: double>>")
    found = raster.marks_at_mean(df, runs, ["r", "g", "b"]).select("obj", colour_class(F.col("r"), F.col("g"), F.col("b")).alias("class"), "r")
    got = {r.obj: (r["class"], r.r is None) for r in found.collect()}
    for k, t, ring in objects:
        colour = None
        if ring and t in masks:
            x, y = (int(sum(p[i] for p in ring) / len(ring)) for i in (0, 1))
            colour = masks[t][y][x] if 0 <= x < 40 and 0 <= y < 12 else None
        assert got[k] == ({(0, 255, 0): 0, (255, 0, 0): 1, (0, 0, 255): 2}.get(colour), colour is None), (k, ring)
    assert len(got) == len(objects)


def test_cells_are_joined_before_they_meet_by_row(spark):
    """Rows of cells that batches and tasks cut anywhere, in any order; null is a mark and a key like any other."""
    draw = random.Random(3)
    cells = [(t, x, y, draw.choice([0, 0, 0, 255, None])) for t in (None, 1, 2, 3) for y in range(9) for x in range(40) if draw.random() < 0.9]
    want = []
    for t, y in itertools.product((None, 1, 2, 3), range(9)):
        for x, m in sorted(((c[1], c[3]) for c in cells if c[0] == t and c[2] == y), key=lambda c: c[0]):
            if want and want[-1][:2] == [t, y] and want[-1][3:] == [x - 1, m]:
                want[-1][3] = x
            else:
                want.append([t, y, x, x, m])
    key = lambda r: (r[0] or 0, *r[1:3])
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for n, tasks, shuffled in ((7, 3, True), (10_000, 1, False)):
            draw.shuffle(cells) if shuffled else cells.sort(key=lambda c: (c[0] or 0, *c[1:3]))
            spark.conf.set(conf, str(n))
            df = spark.createDataFrame(cells, "tile int, cell_x int, cell_y int, m int")
            runs = raster.run_rows(df.repartition(tasks) if shuffled else df.coalesce(1), ["m"])
            assert [list(r) for r in sorted(runs.collect(), key=key)] == sorted(want, key=key)
    finally:
        spark.conf.set(conf, before)
    made = list(raster.joiner(1)([pa.RecordBatch.from_pydict({"tile": [4] * 64, "cell_y": [k % 2 for k in range(64)], "from_x": [k // 2 for k in range(64)], "to_x": [k // 2 for k in range(64)], "m": [1] * 64})]))
    assert [r for b in made for r in b.to_pylist()] == [{"tile": 4, "cell_y": y, "from_x": 0, "to_x": 31, "m": 1} for y in (0, 1)]


def test_mask_query_shuffles_runs_and_not_cells(spark, sf):
    """No stage of the query that writes the mask sends a row for each painted cell."""
    plans, kept = [], raster.run_rows
    try:
        raster.run_rows = lambda *given: plans.append(kept(*given)) or plans[-1]
        found = q_rows.p18_at_mean(spark, sf)
    finally:
        raster.run_rows = kept
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    before_rows_meet = plan[plan.index("Window") :]
    assert before_rows_meet.index("Exchange hashpartitioning") < before_rows_meet.index("MapInArrow") < before_rows_meet.rindex("MapInArrow")
    assert found.count() > 0
