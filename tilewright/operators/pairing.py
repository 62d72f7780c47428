"""Joins by key: tiles and labels, slides and folds, bags and features.

Keys are parsed once into columns and joined by equality. Where only existence matters the other side
is first reduced to distinct keys, so a key with many rows is collapsed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_tiles(tiles: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.join(labels.select(*keys).distinct(), keys, "left_semi")


def empty_tiles(tiles: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.join(labels.select(*keys).distinct(), keys, "left_anti")


def flag_empty(tiles: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every tile with `is_empty`, in one join."""
    seen = labels.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return tiles.join(seen, keys, "left").withColumn("is_empty", F.col("_seen").isNull()).drop("_seen")


def unpaired_labels(labels: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    return labels.join(tiles.select(*keys).distinct(), keys, "left_anti")


def paired_labels(labels: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    return labels.join(tiles.select(*keys).distinct(), keys, "left_semi")


def inherit_fold(df: DataFrame, slides: DataFrame, key: str = "slide") -> DataFrame:
    """Rows take the fold of their slide; rows of unknown slides have none. See `unknown_slides`."""
    return df.join(slides.select(key, "fold"), key, "left")


def unknown_slides(df: DataFrame, slides: DataFrame, key: str = "slide") -> DataFrame:
    """Rows whose slide is not among the given ones."""
    return df.join(slides.select(key).distinct(), key, "left_anti")


def pair_by_name(labels: DataFrame, slides: DataFrame, expected, stain: str | None = None) -> DataFrame:
    """Labels with the slide name they should have; `paired` says whether that slide exists."""
    named = labels.withColumn("slide_name", expected(F.col("label_name")))
    if stain:
        named = named.filter(F.col("label_name").contains(stain))
        slides = slides.filter(F.col("slide_name").contains(stain))
    have = slides.select("slide_name").distinct().withColumn("_have", F.lit(True))
    return named.join(have, "slide_name", "left").withColumn("paired", F.col("_have").isNotNull()).drop("_have")


def completeness(slides: DataFrame, files: DataFrame, kinds: list[str], key: str = "slide", kind: str = "kind") -> DataFrame:
    """Per slide one flag per file kind, and whether anything is missing."""
    have = files.groupBy(key).agg(*[F.bool_or(F.col(kind) == k).alias(k) for k in kinds])
    flags = {k: F.coalesce(F.col(k), F.lit(False)) for k in kinds}
    out = slides.select(key).join(have, key, "left").withColumns(flags)
    complete = F.lit(True)
    for k in kinds:
        complete = complete & F.col(k)
    return out.withColumn("complete", complete)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str], more_than: int = 8) -> DataFrame:
    """Samples not yet tiled: a sample is done once it has more than 8 tiles."""
    finished = done.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > more_than).select(*keys)
    return work.join(finished, keys, "left_anti")


def label_bags(bags: DataFrame, slide_labels: DataFrame) -> DataFrame:
    """(bag, slide, label): a bag has its slide's label."""
    heads = bags.groupBy("bag").agg(F.min("slide").alias("slide"))
    return heads.join(slide_labels.select("slide", "label"), "slide")


def mixed_bags(bags: DataFrame) -> DataFrame:
    """Bags whose instances come from more than one slide."""
    return bags.groupBy("bag").agg(F.min("slide").alias("first"), F.max("slide").alias("last")).filter("first <> last")


def with_crops(preds: DataFrame, crops: DataFrame) -> DataFrame:
    """The k-th row of a prediction file belongs to crop `<tile>_crop<k>`."""
    return preds.join(crops, ["tile", "k"])


def feature_bags(bags: DataFrame, features: DataFrame) -> DataFrame:
    """Replace each instance of a bag by its feature row."""
    return bags.join(features.select("instance", "embedding"), "instance")
