"""Dataset-shaped views over the given tables: customer = slide, order = tile, line item = object.

A view reads only the columns a query uses. `labels` is the cheap form of `boxes` for queries that need
no object number or geometry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import once
from tilewright.operators.ranks import HOT_ROWS, group_rank, hot_cold, hot_keys, split_rank

TILE = 2048
SLIDE_W, SLIDE_H = 6144, 4096
SCORE_IDS = {"Glomerulus": 0, "Cellular Crescent": 1, "FibrousCrescent": 2}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold_of(slide: Column) -> Column:
    return F.when(slide % 10 == 0, "test").when(slide % 10 < 3, "val").otherwise("train")


def tiles(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("tile"), F.col("o_custkey").alias("slide"), (F.col("o_orderkey") % 3).alias("sample"))


def folded_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles(spark, d).withColumn("fold", fold_of(F.col("slide")))


def slides(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("slide")).agg(F.count("*").alias("n_tiles"))
    return n.select("slide", F.lit(SLIDE_W).alias("w"), F.lit(SLIDE_H).alias("h"), "n_tiles")


def _class() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "N", 0).when(flag == "A", 1).otherwise(2)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(tile, slide, sample, class) per object."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tile"), _class().alias("class"))
    return lines.join(tiles(spark, d), "tile")


def boxes(spark: SparkSession, d: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(tile, slide, obj, class, x0, y0, w, h, sx0, sy0) per object; obj numbers the objects of a tile.

    Ordinary tiles are numbered in the shuffle that also joins them to their slide. A tile with more
    than `hot_rows` objects is numbered slice by slice and joined by broadcast.
    """
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("tile"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    owner = tiles(spark, d).select("tile", "slide")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    hot, cold = hot_cold(line, ["tile"], hot_rows)
    in_tile = Window.partitionBy("tile").orderBy(*order)
    plain = cold.withColumn("obj", F.row_number().over(in_tile).cast("bigint")).join(owner, "tile")
    rows = plain
    if hot is not None:
        slices = [F.col("l_linenumber"), F.shiftright("l_partkey", 10)]
        crowded = split_rank(hot, ["tile"], slices, order, "obj")
        few = owner.join(F.broadcast(hot_keys(line, ["tile"], hot_rows)), "tile", "left_semi")  # one row per hot tile
        rows = plain.unionByName(crowded.join(F.broadcast(few), "tile"))
    p, s, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("obj")
    shaped = rows.select(
        "tile", "slide", "obj", _class().alias("class"),
        ((p * 37 + s * 101 + k * 911) % 1500).alias("x0"), ((p * 53 + s * 71 + k * 577) % 1500).alias("y0"),
        (F.col("l_quantity").cast("int") * 8 + 32).alias("w"), ((p * 7 + k * 13) % 400 + 32).alias("h"),
    )
    return shaped.withColumns({
        "sx0": F.col("x0") + (F.col("tile") % 3) * TILE, "sy0": F.col("y0") + (F.col("tile") % 2) * TILE,
    })


def shares(df: DataFrame) -> DataFrame:
    """Pixel boxes as shares of the tile: (…, xc, yc, w, h)."""
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return df.select(
        *[c for c in df.columns if c not in ("x0", "y0", "w", "h", "sx0", "sy0")],
        ((x0 + w / 2) / TILE).alias("xc"), ((y0 + h / 2) / TILE).alias("yc"), (w / TILE).alias("w"), (h / TILE).alias("h"),
    )


def preds(spark: SparkSession, d: str) -> DataFrame:
    return preds_of(boxes(spark, d))


def preds_of(own: DataFrame) -> DataFrame:
    """Shifted copies of nine boxes in ten, and a false one for every eleventh: one pass over the boxes.

    False ones are numbered far above the objects, so that (tile, pred) stays a key in crowded tiles.
    """
    t, o = F.col("tile"), F.col("obj")
    row = lambda pred, x, y, w, h, conf: F.struct(
        pred.alias("pred"), x.cast("bigint").alias("x0"), y.cast("bigint").alias("y0"),
        w.cast("bigint").alias("w"), h.cast("bigint").alias("h"), (conf / 1000.0).alias("conf"),
    )
    copy = row(o, F.col("x0") + (t * 7 + o) % 61 - 30, F.col("y0") + (t * 11 + o) % 61 - 30, F.col("w"), F.col("h"), (t * 31 + o * 17) % 1000)
    false = row(o + 10**12, F.lit(1900), F.lit(1900), F.lit(100), F.lit(100), (t * 13 + o) % 1000)
    both = F.filter(
        F.array(F.when((t + o) % 10 != 0, copy), F.when((t + o) % 11 == 0, false)), lambda r: r.isNotNull()
    )
    rows = own.select("tile", "slide", F.explode(both).alias("_r"))
    return rows.select("tile", "slide", "_r.*")


def rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sample_n")
    rows = slides(spark, d).select("slide", k)
    return rows.select(
        "slide", "sample_n", (F.col("sample_n") * TILE).alias("x0"), F.lit(0).alias("y0"),
        ((F.col("sample_n") + 1) * TILE).alias("x1"), F.lit(SLIDE_H).alias("y1"),
    )


def objects(spark: SparkSession, d: str) -> DataFrame:
    return objects_of(boxes(spark, d))


def objects_of(own: DataFrame) -> DataFrame:
    """Boxes as outlines of nine vertices in slide coordinates, one row per object."""
    rows = own.select("tile", "slide", "obj", "class", "sx0", "sy0", "w", "h")
    return once(rows, "vertices", outline(F.col)).drop("sx0", "sy0", "w", "h")


def outline(field: Callable[[str], Column]) -> Column:
    """The vertices of one box."""
    at = lambda start, size, half: field(start) + F.floor(field(size) * half / 2.0)
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1), (0, 0)]
    return F.array(*[F.struct(at("sx0", "w", a).alias("x"), at("sy0", "h", b).alias("y")) for a, b in ring])


def instances(spark: SparkSession, d: str) -> DataFrame:
    """25 slides that grow with the table, and up to 25 with eight instances each at every size."""
    e = table(spark, d, "embeddings")
    slide = F.when(F.col("vec_id") < 200, F.floor(F.col("vec_id") / 8) + 1000).otherwise(F.col("vec_id") % 25)
    return e.select(
        F.col("vec_id").alias("instance"), slide.alias("slide"), (F.col("label") % 3).alias("class"), "embedding"
    )


def features(spark: SparkSession, d: str) -> DataFrame:
    return instances(spark, d).select("instance", "embedding")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return shape_runs(table(spark, d, "events"))


def shape_runs(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("exp"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("status"), "value",
    )


def epochs(spark: SparkSession, d: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(exp, epoch, precision, recall): an experiment's events in time order. A long one is cut where its own times lie."""
    ranked = group_rank(runs(spark, d), ["exp"], None, ["ts", "event_id"], "epoch", hot_rows)
    return ranked.select("exp", "epoch", F.col("value").alias("precision"), (F.col("event_id") % 100 / 100.0).alias("recall"))


def image_names(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with the file name their image would have."""
    t = folded_tiles(spark, d)
    s = lambda c: F.col(c).cast("string")
    i, j = (F.col("tile") % 7).cast("string"), (F.col("tile") % 5).cast("string")
    name = F.concat(F.lit("S"), s("slide"), F.lit("_PAS_sample"), s("sample"), F.lit("_"), i, F.lit("_"), j)
    return t.withColumn("name", name)
