"""Tables and counts that describe a tile dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.pairing import empty_tiles
from tilewright.operators.quantiles import exact_quantiles


def unique_classes(df: DataFrame) -> DataFrame:
    return df.select("class").distinct()


def class_freq(df: DataFrame, n_classes: int) -> DataFrame:
    """Objects per class 0 … n−1, zero for absent ones. One pass, one row of counts, then unpivoted."""
    counts = df.agg(*[F.count_if(F.col("class") == c).alias(str(c)) for c in range(n_classes)])
    return counts.select(F.posexplode(F.array(*[F.col(str(c)) for c in range(n_classes)])).alias("class", "n"))


def instances_table(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row per object with rounded sizes; a tile without objects has one row of nulls."""
    rows = boxes.select(
        "class", F.bround("w", 4).alias("width"), F.bround("h", 4).alias("height"),
        F.bround(F.col("w") * F.col("h"), 4).alias("area"), "obj", "tile", "fold", "sample", "slide",
    )
    bare = empty_tiles(tiles, boxes, ["tile"]).select("tile", "fold", "sample", "slide")
    return rows.unionByName(bare, allowMissingColumns=True)


def tiles_table(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Per tile its number of objects and `healthy` (any object of class 1), `unhealthy` or `empty`."""
    per_tile = labels.groupBy("tile").agg(F.count("*").alias("n_obj"), F.bool_or(F.col("class") == 1).alias("_healthy"))
    kind = F.when(F.col("n_obj").isNull(), "empty").when(F.col("_healthy"), "healthy").otherwise("unhealthy")
    return tiles.join(per_tile, "tile", "left").select(
        *tiles.columns, F.coalesce("n_obj", F.lit(0)).alias("n_obj"), kind.alias("kind")
    )


def size_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, one row per column. The quartiles are exact."""
    stats = {"n": F.count, "mean": F.mean, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(F.col(c)).alias(f"{c}_{s}") for c in columns for s, f in stats.items()])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    at = lambda c: [F.lit(q).cast("double").alias(name) for name, q in zip(("q1", "median", "q3"), quartiles[c])]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{s}").alias(s) for s in stats], *at(c)) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, width: float, by: str = "fold") -> DataFrame:
    return df.groupBy(by, F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))


def size_scatter(df: DataFrame) -> DataFrame:
    """Objects per whole-percent width and height and class."""
    percent = lambda c: (F.col(c) * 100).cast("int")
    return df.groupBy(percent("w").alias("w_pct"), percent("h").alias("h_pct"), "class").agg(F.count("*").alias("n"))


def kinds_by_fold(tiles: DataFrame, kinds: list[str], by: str = "fold", column: str = "kind") -> DataFrame:
    """A row per fold, a column per kind. The kinds are given, so no extra pass looks for them."""
    return tiles.groupBy(by).agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds])


def objects_per_sample(labels: DataFrame) -> DataFrame:
    return labels.groupBy("slide", "sample").agg(F.count("*").alias("n"))


def fold_inventory(tiles: DataFrame, run: str) -> DataFrame:
    """(run, fold, tile, n_in_fold): a fold's tiles stay rows, since a list of them would have no bound."""
    sizes = tiles.groupBy("fold").agg(F.count("*").alias("n_in_fold"))
    return tiles.select("fold", "tile").join(F.broadcast(sizes), "fold").withColumn("run", F.lit(run))  # 3 folds
