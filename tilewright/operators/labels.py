"""Cleaning label rows and tiles: filters, class edits, repeated rows, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import once
from tilewright.functions.draws import SEED, coin

# What a configuration may name.
ALLOWED = {
    "slide_format": ["svs", "tif"],
    "label_format": ["json", "gson"],
    "datasource": ["muw", "tcd", "hubmap"],
    "task": ["segmentation", "detection"],
    "stain": ["pas", "h&e", "sfog"],
}


def not_test(df: DataFrame) -> DataFrame:
    """Cleaning never touches the test fold. On a `fold`-partitioned table this prunes directories."""
    return df.filter(F.col("fold") != "test")


def min_size(df: DataFrame, column: str, at_least: int) -> DataFrame:
    return df.filter(F.col(column) >= at_least)


def drop_small(df: DataFrame, w_min: float = 0.15, h_min: float = 0.15) -> DataFrame:
    return df.filter((F.col("w") >= w_min) & (F.col("h") >= h_min))


def drop_small_counts(df: DataFrame, w_min: float = 0.15, h_min: float = 0.15) -> DataFrame:
    """Objects before and after `drop_small`, in one pass."""
    kept = (F.col("w") >= w_min) & (F.col("h") >= h_min)
    return df.agg(F.count("*").alias("n_before"), F.count_if(kept).alias("n_after"))


def drop_class(df: DataFrame, cid: int) -> DataFrame:
    """Remove a class; a class that does not occur changes nothing, and rows without a class stay."""
    return df.filter(~F.col("class").eqNullSafe(F.lit(cid)))


def emptied_tiles(before: DataFrame, after: DataFrame, key: str = "tile") -> DataFrame:
    """Tiles that had label rows and have none left."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def with_annotations(files: DataFrame, annotations: DataFrame, key: str, text: str) -> DataFrame:
    """Drop every file of a slide whose annotation text holds no `{`."""
    real = annotations.filter(F.contains(F.col(text), F.lit("{"))).select(key).distinct()
    return files.join(real, key, "left_semi")


def squarish(df: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Drop crops much narrower than tall, or the reverse."""
    w, h = F.col("w"), F.col("h")
    return df.filter(~((w < h * ratio) | (h < w * ratio)))


def at_least_tile(rects: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    return rects.filter((F.col("x1") - F.col("x0") >= tile_w) & (F.col("y1") - F.col("y0") >= tile_h))


def min_area(objects: DataFrame, at_least: float = 40) -> DataFrame:
    """Outlines with at least the given area, which is added as `area`."""
    return once(objects, "area", g.area(F.col("vertices")), lambda a: a >= at_least)


def by_confidence(preds: DataFrame, registry: DataFrame, model: str, task: str, classify: bool) -> DataFrame:
    """Detections at or above the registered model's threshold, tagged with its weights.

    A model that is not registered, twice, or without a threshold is an error.
    """
    entry = registry.filter((F.col("model") == model) & (F.col("task") == task) & (F.col("classify") == F.lit(classify)))
    found = entry.select("conf_thres", "weights").head(2)
    if len(found) != 1 or found[0]["conf_thres"] is None:
        raise ValueError(f"no threshold for {model}, {task}, classes {classify}")
    return preds.filter(F.col("conf") >= found[0]["conf_thres"]).withColumn("weights", F.lit(found[0]["weights"]))


def model_registry(spark) -> DataFrame:
    """Confidence thresholds of the best models."""
    rows = [
        ("yolo", "detection", True, 0.425, "detection_classes.pt"),
        ("yolo", "detection", False, 0.2, "detection.pt"),
        ("yolo", "segmentation", True, None, None),
        ("yolo", "segmentation", False, 0.2, "segmentation.pt"),
    ]
    return spark.createDataFrame(rows, "model string, task string, classify boolean, conf_thres double, weights string")


def not_allowed(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """One row per (row, column) whose value is missing or outside the column's allow-list."""
    reasons = F.filter(
        F.array(*[
            F.when(~F.coalesce(F.col(c).isin(list(values)), F.lit(False)), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
            for c, values in allowed.items()
        ]),
        lambda r: r.isNotNull(),
    )
    return df.withColumn("_bad", F.explode(reasons)).select("*", "_bad.column", "_bad.value").drop("_bad")


def bad_ratio(ratio: Column) -> Column:
    """True unless the array holds 2 or 3 shares that sum to 1 (to two digits)."""
    total = F.aggregate(ratio, F.lit(0.0), lambda acc, x: acc + x)
    return ~(F.size(ratio).isin(2, 3) & (F.round(total, 2) == 1.0))


def not_zero_indexed(class_map: Column) -> Column:
    """True unless the ids of a name → id map are 0, 1, …, n−1."""
    ids = F.array_sort(F.map_values(class_map))
    return ~F.coalesce(ids == F.sequence(F.lit(0), F.size(class_map) - 1), F.lit(False))


def crowded_tiles(df: DataFrame, most: int = 30, key: str = "tile") -> DataFrame:
    """Tiles with more label rows than plausible."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def class_set_problems(df: DataFrame, group: str, column: str, expected: list[str]) -> DataFrame:
    """(group, class, problem): expected classes a group lacks, classes it should not have."""
    seen = df.select(group, column).distinct()
    held = seen.groupBy(group).agg(F.collect_set(F.when(F.col(column).isin(expected), F.col(column))).alias("held"))
    wanted = F.array(*[F.lit(e) for e in expected])
    missing = held.select(group, F.explode(F.array_except(wanted, "held")).alias(column), F.lit("missing").alias("problem"))
    extra = seen.filter(~F.col(column).isin(expected)).select(group, column, F.lit("extra").alias("problem"))
    return missing.unionByName(extra)


def replace_class(df: DataFrame, old: int, new: int) -> DataFrame:
    """`old` becomes `new`. See `replace_problems` for the conditions."""
    if old == new:
        raise ValueError("old and new class must differ")
    return df.withColumn("class", F.when(F.col("class") == old, F.lit(new)).otherwise(F.col("class")))


def replace_problems(df: DataFrame, old: int, new: int) -> DataFrame:
    """Violations of `replace_class`: `old` must occur and `new` must not."""
    seen = df.agg(F.coalesce(F.bool_or(F.col("class") == old), F.lit(False)).alias("old"),
                  F.coalesce(F.bool_or(F.col("class") == new), F.lit(False)).alias("new"))
    found = F.array(F.when(~F.col("old"), F.lit("old class missing")), F.when(F.col("new"), F.lit("new class present")))
    return seen.select(F.explode(found).alias("problem")).filter("problem is not null")


def merge_classes(df: DataFrame, a: int, b: int) -> DataFrame:
    if a == b:
        raise ValueError("classes must differ")
    return df.withColumn("class", F.when(F.col("class") == max(a, b), F.lit(min(a, b))).otherwise(F.col("class")))


def switch_binary(df: DataFrame) -> DataFrame:
    return df.withColumn("class", F.when(F.col("class") == 1, 0).otherwise(1))


def assign_randomly(df: DataFrame, keys: list[str], unknown: int = 1, to: tuple[int, int] = (0, 2), seed: int = SEED) -> DataFrame:
    """Objects of the unknown class fall to one of two classes by a coin on their key."""
    pick = F.when(coin(*keys, seed=seed) == 0, F.lit(to[0])).otherwise(F.lit(to[1]))
    return df.withColumn("class", F.when(F.col("class") == unknown, pick).otherwise(F.col("class")))


def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line of a text, with its 0-based position."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def first_lines(df: DataFrame, *keys: str) -> DataFrame:
    """Repeated lines of a file collapse to the first one. Partial aggregation shrinks copies before the shuffle."""
    return df.groupBy(*keys, "line").agg(F.min("pos").alias("pos"))
