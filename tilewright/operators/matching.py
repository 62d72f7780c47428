"""Predictions against ground truth on the same tile.

Boxes (pixels: x0, y0, w, h) are filed under every grid cell they cover and points under their one cell,
and the join runs on (tile, cell). A crowded tile is thus spread over its cells, and boxes far from a
point are never compared with it. Matches are folded into one row per prediction by map-side
aggregation; pairs are not kept. Boxes are clipped to the tile, so that one in other coordinates is not filed
under millions of cells; those outside of it match nothing, and `outside_tile` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as g

# Cells a tile's side is cut into. More of them compare fewer pairs in crowded tiles, fewer file a box under fewer cells.
CELLS = 8
# Where both sides are boxes, both are filed under every cell they cover.
BOX_CELLS = 4


def _cell(x: Column, cell: int) -> Column:
    return F.floor(x / cell).cast("int")


def _by_cell(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: int) -> DataFrame:
    rows = df.filter((x1 >= x0) & (y1 >= y0)).withColumn("_cx", F.explode(F.sequence(_cell(x0, cell), _cell(x1, cell))))
    return rows.withColumn("_cy", F.explode(F.sequence(_cell(y0, cell), _cell(y1, cell))))


def _corners(p: str = "") -> tuple[Column, Column, Column, Column]:
    x0, y0 = F.col(p + "x0"), F.col(p + "y0")
    return x0, y0, x0 + F.col(p + "w"), y0 + F.col(p + "h")


def _clipped(p: str, tile: int) -> tuple[Column, Column, Column, Column]:
    x0, y0, x1, y1 = _corners(p)
    return F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0)), F.least(x1, F.lit(tile)), F.least(y1, F.lit(tile))


def _prefixed(df: DataFrame, columns: list[str], p: str) -> DataFrame:
    return df.select("tile", *[F.col(c).alias(p + c) for c in columns])


def outside_tile(boxes: DataFrame, tile: int) -> DataFrame:
    """Boxes with no point on a tile of `tile` pixels, of negative size or without a number: they can match nothing. None should be left."""
    x0, y0, x1, y1 = _clipped("", tile)
    whole = sum((F.col(c) for c in ("x0", "y0", "w", "h")), F.lit(0)).isNotNull()
    return boxes.filter(~F.coalesce(whole & (x1 >= x0) & (y1 >= y0), F.lit(False)))


def match_predictions(preds: DataFrame, truth: DataFrame, tile: int, cell: int | None = None) -> DataFrame:
    """Each prediction with the class of the nearest true box that holds its centre; null = false positive.

    Ties in distance go to the smaller object number.
    """
    cell = cell or -(-tile // CELLS)
    cx, cy = F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("h") / 2
    points = preds.withColumns({"_px": cx, "_py": cy})
    points = points.withColumns({"_cx": _cell(F.col("_px"), cell), "_cy": _cell(F.col("_py"), cell)})
    boxes = _by_cell(_prefixed(truth, ["obj", "class", "x0", "y0", "w", "h"], "g_"), *_clipped("g_", tile), cell)
    inside = g.holds(*_clipped("g_", tile), F.col("_px"), F.col("_py"))
    key = ["tile", "_cx", "_cy"]
    pairs = points.alias("p").join(
        boxes.alias("b"), [F.col(f"p.{k}") == F.col(f"b.{k}") for k in key] + [inside], "left"
    ).drop(*[F.col(f"b.{k}") for k in key])
    dx = F.col("_px") - (F.col("g_x0") + F.col("g_w") / 2)
    dy = F.col("_py") - (F.col("g_y0") + F.col("g_h") / 2)
    # An empty match must not win, so its order key is null and min_by skips it.
    nearest = F.when(F.col("g_obj").isNotNull(), F.struct((dx * dx + dy * dy).alias("d"), F.col("g_obj").alias("o")))
    match = F.min_by(F.struct(F.col("g_obj").alias("obj"), F.col("g_class").alias("class")), nearest)
    kept = [c for c in preds.columns if c not in ("tile", "pred")]
    return (
        # A prediction lies in one cell, so these groups are the predictions, and the join's partitioning serves.
        pairs.groupBy("tile", "_cx", "_cy", "pred")
        .agg(
            *[F.first(c).alias(c) for c in kept],  # constant within a prediction
            F.count("g_obj").alias("n_matches"),
            match.alias("_m"),
        )
        .withColumns({"obj": F.col("_m.obj"), "class": F.col("_m.class")})
        .drop("_m", "_cx", "_cy")
    )


def overlap_match(preds: DataFrame, truth: DataFrame, tile: int, share: float = 0.25, cell: int | None = None) -> DataFrame:
    """Per prediction the true boxes that cover at least `share` of it: how many, and the best one.

    Both sides are clipped to the tile and filed by cell; a pair counts only in the cell of its intersection's first corner.
    """
    cell = cell or -(-tile // BOX_CELLS)
    p = _by_cell(_prefixed(preds, ["pred", "x0", "y0", "w", "h"], "p_"), *_clipped("p_", tile), cell)
    t = _by_cell(_prefixed(truth, ["obj", "class", "x0", "y0", "w", "h"], "g_"), *_clipped("g_", tile), cell)
    px0, py0, px1, py1 = _clipped("p_", tile)
    gx0, gy0, gx1, gy1 = _clipped("g_", tile)
    ix0, iy0 = F.greatest(px0, gx0), F.greatest(py0, gy0)
    iw, ih = F.least(px1, gx1) - ix0, F.least(py1, gy1) - iy0
    covered = (iw * ih) / (F.col("p_w") * F.col("p_h"))
    home = (F.col("_cx") == _cell(ix0, cell)) & (F.col("_cy") == _cell(iy0, cell))
    pairs = p.join(t, ["tile", "_cx", "_cy"]).filter((iw > 0) & (ih > 0) & home & (covered >= share))
    found = pairs.groupBy("tile", F.col("p_pred").alias("pred")).agg(
        F.count("*").alias("n_matches"),
        F.max_by(
            F.struct(F.col("g_obj").alias("obj"), F.col("g_class").alias("class"), covered.alias("covered")),
            F.struct(covered.alias("s"), (-F.col("g_obj")).alias("o")),
        ).alias("_m"),
    )
    return (
        preds.select("tile", "pred").join(found, ["tile", "pred"], "left")
        .select("tile", "pred", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "_m.obj", "_m.class", "_m.covered")
    )


def refine_class(base: DataFrame, fine: DataFrame, tile: int, cell: int | None = None) -> DataFrame:
    """Finer class of each base object from the objects whose centre lies in it, itself left out.

    None found: class 0. One distinct class: that class. Several: `conflict` and no class.
    """
    cell = cell or -(-tile // CELLS)
    cx, cy = F.col("f_x0") + F.col("f_w") / 2, F.col("f_y0") + F.col("f_h") / 2
    points = _prefixed(fine, ["class", "x0", "y0", "w", "h"], "f_").withColumns({"_px": cx, "_py": cy})
    points = points.withColumns({"_cx": _cell(F.col("_px"), cell), "_cy": _cell(F.col("_py"), cell)})
    same = ["class", "x0", "y0", "w", "h"]
    boxes = _by_cell(_prefixed(base, ["obj", *same], "g_"), *_clipped("g_", tile), cell)
    inside = g.holds(*_clipped("g_", tile), F.col("_px"), F.col("_py"))
    itself = F.lit(True)
    for c in same:
        itself = itself & (F.col("g_" + c) == F.col("f_" + c))
    found = (
        boxes.join(points, ["tile", "_cx", "_cy"]).filter(inside & ~itself)
        .groupBy("tile", F.col("g_obj").alias("obj"))
        .agg(F.count("*").alias("n_found"), F.min("f_class").alias("_lo"), F.max("f_class").alias("_hi"))
    )
    one = F.when(F.col("_lo").isNull(), F.lit(0)).when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    return base.select("tile", "obj").join(found, ["tile", "obj"], "left").select(
        "tile", "obj", F.coalesce("n_found", F.lit(0)).alias("n_found"), one.alias("refined"),
        F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("conflict"),
    )
