"""Sample rectangles, tile windows, and objects cut into them.

Which windows an object touches follows from its coordinates, so cutting is an explode of a short index
sequence per object; nothing is joined and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tilewright.functions import geometry as g
from tilewright.functions import let
from tilewright.operators.outlines import cutter
from tilewright.operators.raster import painter
from tilewright.operators.ranks import HOT_ROWS, hot_cold
from tilewright.operators.spatial import points_in_boxes


def rects_from_features(df: DataFrame, features: str = "features") -> DataFrame:
    """One row per rectangle feature; `valid` is false unless it has 5 vertices and a positive size."""
    ring = F.get(F.col("_f.geometry.coordinates"), 0)
    at = lambda k, i: F.get(F.get(ring, k), i)
    x0, y0, x1, y1 = at(0, 0), at(0, 1), at(2, 0), at(2, 1)
    rows = df.select("slide", F.posexplode(features).alias("sample_n", "_f"))
    return rows.select(
        "slide", "sample_n", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        (x1 - x0).alias("w"), (y1 - y0).alias("h"),
        F.coalesce((F.size(ring) == 5) & (x1 > x0) & (y1 > y0), F.lit(False)).alias("valid"),
    )


def with_default_rect(slides: DataFrame, rects: DataFrame) -> DataFrame:
    """A slide without a rectangle is one sample that covers it."""
    num = dict(rects.dtypes)["x0"]
    whole = {"sample_n": F.lit(0), "x0": F.lit(0), "y0": F.lit(0), "x1": F.col("slide_w"), "y1": F.col("slide_h")}
    joined = slides.select("slide", F.col("w").alias("slide_w"), F.col("h").alias("slide_h")).join(
        rects.select("slide", "sample_n", "x0", "y0", "x1", "y1"), "slide", "left"
    )
    missing = F.col("sample_n").isNull()
    kinds = {"sample_n": "int", **dict.fromkeys(("x0", "y0", "x1", "y1"), num)}
    return joined.select("slide", *[
        F.when(missing, whole[c].cast(kinds[c])).otherwise(F.col(c).cast(kinds[c])).alias(c) for c in kinds
    ])


def tile_grid(rects: DataFrame, tile: int, step: int) -> DataFrame:
    """Windows per axis and in all; i counts rows, j counts columns."""
    n_i = g.n_windows(F.col("y1") - F.col("y0"), tile, step)
    n_j = g.n_windows(F.col("x1") - F.col("x0"), tile, step)
    return rects.withColumns({"n_i": n_i, "n_j": n_j}).withColumn("n_tiles", F.col("n_i") * F.col("n_j"))


def tile_windows(rects: DataFrame, tile: int, step: int) -> DataFrame:
    """One row per window of every rectangle, with its corner in rectangle coordinates."""
    grid = tile_grid(rects, tile, step).filter("n_tiles > 0")
    rows = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    return rows.select("slide", "sample_n", "i", "j", (F.col("j") * step).alias("x"), (F.col("i") * step).alias("y"))


def sample_count(rects: DataFrame) -> DataFrame:
    return rects.groupBy("slide").agg((F.max("sample_n") + 1).alias("n_samples"))


def samples_of_objects(objects: DataFrame, rects: DataFrame, clip: bool = True) -> DataFrame:
    """Objects go to every rectangle of their slide that holds their centroid, in its coordinates.

    The join is spatial: a slide may have any number of rectangles and any share of the objects.
    """
    named = objects.filter(F.coalesce(F.col("class_name"), F.lit("Glo-NA")) != "Tissue")
    centre = named.withColumns({
        "class_name": F.coalesce("class_name", F.lit("Glo-NA")), "_c": g.centroid(F.col("vertices")),
    })
    box = rects.select("slide", "sample_n", "x0", "y0", "x1", "y1")
    moved = g.clip_shift(F.col("vertices"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")], clip=clip)
    size = {"region_w": F.col("x1") - F.col("x0"), "region_h": F.col("y1") - F.col("y0")}
    found = points_in_boxes(centre, box, "slide", F.col("_c.x"), F.col("_c.y")).withColumns({"vertices": moved, **size})
    return found.drop("_c", "x0", "y0", "x1", "y1")


def crowded_slides(rects: DataFrame, most: int = 10) -> DataFrame:
    """(slide, n): slides with more rectangles than tile names can tell apart, which hold one digit for the sample."""
    return rects.groupBy("slide").agg(F.count("*").alias("n")).filter(F.col("n") > most)


def tile_boxes(df: DataFrame, tile: int, step: int, width: Column, height: Column) -> DataFrame:
    """Boxes (x0, y0, w, h in region pixels) clipped to every window they reach, as shares of the tile."""
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    x1, y1 = x0 + F.col("w"), y0 + F.col("h")
    rows = df.withColumn("tile_j", F.explode(g.touched_windows(x0, x1, width, tile, step, True)))
    rows = rows.withColumn("tile_i", F.explode(g.touched_windows(y0, y1, height, tile, step, True)))
    left, top = F.col("tile_j") * step, F.col("tile_i") * step
    cx0, cx1 = F.greatest(x0, left), F.least(x1, left + tile)
    cy0, cy1 = F.greatest(y0, top), F.least(y1, top + tile)
    return rows.select(
        *[c for c in df.columns if c not in ("x0", "y0", "w", "h")], "tile_i", "tile_j",
        (((cx0 + cx1) / 2 - left) / tile).alias("xc"), (((cy0 + cy1) / 2 - top) / tile).alias("yc"),
        ((cx1 - cx0) / tile).alias("w"), ((cy1 - cy0) / tile).alias("h"),
    )


def untile_boxes(df: DataFrame, tile: int, step: int, keys: list[str]) -> DataFrame:
    """Tile boxes back to region pixels; the pieces of an object in overlapping tiles become one box."""
    left, top = F.col("tile_j") * step, F.col("tile_i") * step
    x0, x1 = (F.col("xc") - F.col("w") / 2) * tile + left, (F.col("xc") + F.col("w") / 2) * tile + left
    y0, y1 = (F.col("yc") - F.col("h") / 2) * tile + top, (F.col("yc") + F.col("h") / 2) * tile + top
    return df.groupBy(*keys).agg(
        F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")
    )


def tile_polygons(df: DataFrame, tile: int, step: int, width: Column, height: Column) -> DataFrame:
    """The vertices of every object inside every window that holds one, in drawing order, in tile pixels.

    Outlines are cut in Arrow batches where they lie: lambdas over every vertex of every window are evaluated one by one.
    """
    kept = [c for c in df.columns if c != "vertices"]
    sizes = df.select(*kept, "vertices", width.alias("_w"), height.alias("_h"))
    kinds = sizes.select(F.least(F.lit(0).cast("bigint"), F.col("_w") - 1).alias("x"), F.least(F.lit(0).cast("bigint"), F.col("_h") - 1).alias("y"))
    vertex = StructType([StructField(f.name, f.dataType) for f in kinds.schema])
    schema = StructType([*df.select(*kept).schema, StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("vertices", ArrayType(vertex))])
    whole = lambda c: F.col(f"vertices.{c}").cast("array<bigint>").alias(f"_{c}s")
    most = lambda c, n: (F.col(c) - 1).cast(vertex[n].dataType).alias(c)
    windows = lambda c: g.n_windows(F.col(c), tile, step)
    rows = sizes.filter(F.size("vertices") > 0).select(
        *kept, whole("x"), whole("y"), most("_w", 0), most("_h", 1), windows("_w").alias("_nj"), windows("_h").alias("_ni")
    )
    return rows.mapInArrow(cutter(kept, tile, step), schema)


def normalise_vertices(df: DataFrame, tile: int) -> DataFrame:
    share = lambda p: F.struct((p["x"] / tile).alias("x"), (p["y"] / tile).alias("y"))
    return df.withColumn("vertices", F.transform("vertices", share))


def rasterise(df: DataFrame, cell: int, tile: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Boxes painted on a grid of `cell`-pixel cells, later objects over earlier ones: object number and class+1.

    Corners are whole pixels and included, as a filled rectangle is drawn. Boxes are dealt by tile and painted in object
    order, tile after tile, so that cells are neither shuffled nor kept. A tile with more than `hot_rows` boxes is
    painted wherever its boxes lie, and its cells, no more than a grid has, are put together.
    """
    last = (tile - 1) // cell
    at = lambda x: F.least(F.greatest(F.floor(x / cell), F.lit(0)), F.lit(last)).cast("int")
    on_grid = (
        (F.col("x0") + F.col("w") >= 0) & (F.col("y0") + F.col("h") >= 0) & (F.col("x0") < tile) & (F.col("y0") < tile)
    )
    ends = {"x": (at(F.col("x0")), at(F.col("x0") + F.col("w"))), "y": (at(F.col("y0")), at(F.col("y0") + F.col("h")))}
    # Without a number an object is below all others, and marks nothing.
    mark = F.when(F.col("obj").isNotNull(), F.col("class") + 1)
    boxes = df.filter(on_grid).select(
        "tile", F.col("obj").alias("object"), mark.alias("class_mark"),
        *[f(*ends[c]).alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.least, F.greatest))],
    )
    kinds = dict(boxes.dtypes)
    schema = f"tile {kinds['tile']}, cell_x int, cell_y int, object {kinds['object']}, class_mark {kinds['class_mark']}"
    hot, cold = hot_cold(boxes, ["tile"], hot_rows)
    # Dealt by a hash of the tile, which no earlier step has dealt by: rows of a tile meet whatever the optimiser does there.
    painted = cold.repartition(F.xxhash64("tile")).sortWithinPartitions("tile", "object").mapInArrow(painter(last + 1), schema)
    if hot is None:
        return painted
    cells = hot.select("tile", F.explode(F.sequence("x0", "x1")).alias("cell_x"), "y0", "y1", "object", "class_mark")
    cells = cells.withColumn("cell_y", F.explode(F.sequence("y0", "y1"))).groupBy("tile", "cell_x", "cell_y")
    return painted.unionByName(cells.agg(F.max("object").alias("object"), F.max_by("class_mark", "object").alias("class_mark")))
