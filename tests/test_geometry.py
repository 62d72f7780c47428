"""Outlines and windows on hand-made rows."""

import random

from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import names as nm
from tilewright.operators import tiling


def outline(spark, points, kind="bigint"):
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in points],)], f"vertices array<struct<x:{kind},y:{kind}>>")
    return df


def points(df, column):
    return [(p["x"], p["y"]) for p in df.select(F.expr("*"), column.alias("out")).first()["out"]]


def test_midpoints_truncate_towards_zero_and_keep_the_ends(spark):
    df = outline(spark, [(0, 0), (3, -3), (10, 10)])
    assert points(df, g.midpoints(F.col("vertices"))) == [(0, 0), (1, -1), (3, -3), (6, 3), (10, 10)]
    assert len(points(df, g.midpoints(F.col("vertices"), 3))) == 17


def test_midpoints_leave_fractions_of_given_vertices(spark):
    df = outline(spark, [(0.5, 0.5), (4.0, 4.0)], "double")
    assert points(df, g.midpoints(F.col("vertices"))) == [(0.5, 0.5), (2.0, 2.0), (4.0, 4.0)]


def test_midpoints_of_one_vertex(spark):
    assert points(outline(spark, [(5, 6)]), g.midpoints(F.col("vertices"))) == [(5, 6)]


def test_area_joins_last_and_first_vertex(spark):
    square = outline(spark, [(0, 0), (10, 0), (10, 10), (0, 10)])
    assert square.select(g.area(F.col("vertices"))).first()[0] == 100
    closed = outline(spark, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])
    assert closed.select(g.area(F.col("vertices"))).first()[0] == 100


def test_corner_is_added_once(spark):
    ring = g.with_corner(F.col("vertices"), 1000, 1000)
    assert points(outline(spark, [(0, 500), (500, 0), (500, 500)]), ring) == [(0, 500), (0, 0), (500, 0), (500, 500)]
    assert points(outline(spark, [(999, 500), (500, 999), (0, 500), (500, 0)]), ring) == [
        (999, 500), (1000, 1000), (500, 999), (0, 500), (500, 0)
    ]
    same = [(0, 500), (500, 500), (500, 0)]
    assert points(outline(spark, same), ring) == same
    assert points(outline(spark, [(1, 1)]), ring) == [(1, 1)]


def test_box_rows_of_both_forms(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.2, 0.4],), ([0.4, 0.3, 0.6, 0.3, 0.6, 0.7, 0.4, 0.7],), ([1.0, 2.0],)], "n array<double>")
    a, b, c = [r[0] for r in df.select(g.box_from_numbers(F.col("n"))).collect()]
    assert [round(v, 12) for v in b] == [round(v, 12) for v in a] and c is None


def boxes(spark, rows):
    return spark.createDataFrame(rows, "obj int, x0 bigint, y0 bigint, w bigint, h bigint")


def cut(spark, rows, tile=100, step=50, w=200, h=100):
    return tiling.tile_boxes(boxes(spark, rows), tile, step, F.lit(w), F.lit(h))


def test_box_that_touches_a_window_edge_gets_a_piece_of_no_width(spark):
    got = {(r.tile_i, r.tile_j): (round(r.w * 100), round(r.h * 100)) for r in cut(spark, [(1, 100, 10, 20, 20)]).collect()}
    assert got == {(0, 0): (0, 20), (0, 1): (20, 20), (0, 2): (20, 20)}


def test_box_wider_than_a_tile_is_in_every_window_it_spans(spark):
    got = {r.tile_j: (r.xc, r.w) for r in cut(spark, [(1, 0, 0, 200, 50)]).collect()}
    assert got == {0: (0.5, 1.0), 1: (0.5, 1.0), 2: (0.5, 1.0)}


def test_tiles_back_to_slide(spark):
    rows = [(1, 3, 7, 150, 40), (2, 100, 60, 99, 39)]
    back = tiling.untile_boxes(cut(spark, rows), 100, 50, ["obj"]).collect()
    assert {(r.obj, *(round(v, 9) for v in (r.x0, r.y0, r.x1 - r.x0, r.y1 - r.y0))) for r in back} == set(rows)


def test_polygon_pieces_are_half_open_and_clamped(spark):
    df = outline(spark, [(99, 0), (100, 0), (250, 50)]).withColumn("obj", F.lit(1))
    got = tiling.tile_polygons(df, 100, 50, F.lit(200), F.lit(100)).collect()
    assert {(r.i, r.j): [(p.x, p.y) for p in r.vertices] for r in got} == {
        (0, 0): [(99, 0)], (0, 1): [(49, 0), (50, 0)], (0, 2): [(0, 0), (99, 50)]
    }


def test_windows_of_a_known_region(spark):
    rect = spark.createDataFrame([("s", 0, 0, 0, 16382, 5781)], "slide string, sample_n int, x0 int, y0 int, x1 int, y1 int")
    row = tiling.tile_grid(rect, 2048, 512).first()
    # 28 × 8 windows, as a log of the original run says for a region of this size.
    assert (row.n_j, row.n_i, row.n_tiles) == ((16382 - 2048) // 512 + 1, (5781 - 2048) // 512 + 1, 28 * 8)
    small = rect.withColumn("x1", F.lit(100))
    assert tiling.tile_grid(small, 2048, 512).first().n_tiles == 0 and tiling.tile_windows(small, 2048, 512).count() == 0


def test_names(spark):
    df = spark.createDataFrame([
        ("a", "Augm_3_BH13_PAS_sample0_11_5_crop2.jpg"), ("b", "I_4_S_5_ROI_4_PAS.tif"), ("c", "X_PAS.tif"),
    ], "k string, f string")
    got = {r.k: r.n for r in df.select("k", nm.parse_name(F.col("f")).alias("n")).collect()}
    a = got["a"]
    assert (a.slide, a.sample, a.tile_i, a.tile_j, a.crop, a.copy, a.tile) == ("BH13_PAS", 0, 11, 5, 2, 3, "BH13_PAS_sample0_11_5")
    assert got["b"].slide == "I_4_S_5_" and got["c"].slide == "X_PAS" and got["c"].sample is None


def test_corners_of_odd_outlines(spark):
    """Against a plain loop: no outline, no vertex, vertices without a number, two jumps."""
    draw = random.Random(5)
    some = [0, 1, 2, 50, 98, 99, 100, 101, -1, None]
    rings = [None, [], [None], [(0, 50)], [(None, 0), (0, None), (50, 0)]] + [[draw.choice([None, *[(draw.choice(some), draw.choice(some)) for _ in range(9)]]) for _ in range(draw.randint(1, 7))] for _ in range(300)]

    def plain(ring):
        edge = lambda c: None if c is None else 0 if 0 <= c / 100 <= 0.02 else 1 if 0.98 <= c / 100 <= 1 else None
        sides = [(None, None) if p is None else (edge(p[0]), edge(p[1])) for p in ring]
        for k, (p, q) in enumerate(zip(sides, sides[1:])):
            if p[0] is not None and q[1] is not None:
                return ring[: k + 1] + [(p[0] * 100, q[1] * 100)] + ring[k + 1 :]
            if p[1] is not None and q[0] is not None:
                return ring[: k + 1] + [(q[0] * 100, p[1] * 100)] + ring[k + 1 :]
        return ring

    df = spark.createDataFrame(list(enumerate(rings)), "n int, v array<struct<x:bigint,y:bigint>>")
    got = {r.n: r.c and [p and tuple(p) for p in r.c] for r in df.select("n", g.with_corner(F.col("v"), 100, 100, 0.02).alias("c")).collect()}
    assert got == {n: ring and plain(ring) for n, ring in enumerate(rings)}


def test_pieces_of_odd_outlines(spark):
    """Outlines without vertices or numbers, regions below a tile, fractions and negative places, against a plain loop."""
    draw = random.Random(7)
    at = lambda: draw.choice([None, -70.5, -3, 0, 31.9, draw.uniform(-50, 400), draw.uniform(0, 300)])
    rows = [(n, draw.choice([None, 50, 64, 100, 250, 300.5]), draw.choice([64, 200, None]), draw.choice([None, [], *[[draw.choice([None, (at(), at()), (at(), at())]) for _ in range(draw.randint(1, 9))] for _ in range(8)]])) for n in range(400)]
    rows = [(n, w and float(w), h, v and [p and tuple(None if c is None else float(c) for c in p) for p in v]) for n, w, h, v in rows]
    df = spark.createDataFrame(rows, "n int, w double, h int, vertices array<struct<x:double,y:double>>")
    got = sorted((r.n, r.i, r.j, tuple(tuple(p) for p in r.vertices)) for r in tiling.tile_polygons(df.withColumn("h", F.col("h").cast("double")), 64, 32, F.col("w"), F.col("h")).collect())
    want = []
    for n, w, h, v in rows:
        if not v or w is None or h is None:
            continue
        pull = lambda c, most: float(most - 1 if c is None else min(int(c), most - 1))
        whole = [(pull(p and p[0], w), pull(p and p[1], h)) for p in v]
        for j in range(max(int((w - 64) // 32) + 1, 0)):
            for i in range(max(int((h - 64) // 32) + 1, 0)):
                held = tuple((x - j * 32, y - i * 32) for x, y in whole if 0 <= x - j * 32 < 64 and 0 <= y - i * 32 < 64)
                if held:
                    want.append((n, i, j, held))
    assert got == sorted(want)


def test_painting_in_small_batches_and_of_hot_tiles(spark):
    """A tile over many batches, tiles above `hot_rows`, objects without a number or class: all as if painted one by one."""
    draw = random.Random(9)
    rows = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, *range(400)]) if k % 9 == 0 else 1000 + k, draw.choice([0, 1, None]), draw.randint(-40, 120), draw.randint(-40, 120), draw.randint(-5, 60), draw.randint(0, 60)) for k in range(500)]
    rows = [r for k, r in enumerate(rows) if r[1] is None or r[1] >= 1000 or r[1] not in {q[1] for q in rows[:k]}]
    want = {}
    for tile, obj, cid, x0, y0, w, h in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        if x0 + w >= 0 and y0 + h >= 0 and x0 < 100 and y0 < 100:
            span = lambda a, b: range(min(max(min(a, b) // 10, 0), 9), min(max(max(a, b) // 10, 0), 9) + 1)
            for x in span(x0, x0 + w):
                for y in span(y0, y0 + h):
                    want[tile, x, y] = (obj, None if obj is None or cid is None else cid + 1)
    df = spark.createDataFrame(rows, "tile bigint, obj bigint, class int, x0 int, y0 int, w int, h int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot in (100, 10_000):
            got = [tuple(r) for r in tiling.rasterise(df, 10, 100, hot).collect()]
            assert len(got) == len(want) and {r[:3]: r[3:] for r in got} == want
        plan = tiling.rasterise(df, 10, 100)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "cell_x" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
