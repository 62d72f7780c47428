"""File names to key columns and back: `<slide>_sample<k>_<i>_<j>.png`, `<tile>_crop<n>.jpg`, `Augm_<m>_<name>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COPY_PREFIX = r"^Augm_(\d+)_"
TILE_PART = r"sample(\d+)_(\d+)_(\d+)"


def stem(name: Column) -> Column:
    """Text before the first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def _number(text: Column) -> Column:
    return F.when(text == "", None).otherwise(text.cast("int"))


def slide_of(name: Column) -> Column:
    """Slide a file belongs to: text before `_sample`, before `ROI`, or the first two `_` tokens."""
    plain = stem(F.regexp_replace(name, COPY_PREFIX, ""))
    return (
        F.when(plain.contains("_sample"), F.split_part(plain, F.lit("_sample"), F.lit(1)))
        .when(plain.contains("ROI"), F.split_part(plain, F.lit("ROI"), F.lit(1)))
        .otherwise(F.array_join(F.slice(F.split(plain, "_"), 1, 2), "_"))
    )


def parse_name(name: Column) -> Column:
    """struct(slide, sample, tile_i, tile_j, crop, copy, tile) of a tile, crop or copied crop."""
    plain = stem(F.regexp_replace(name, COPY_PREFIX, ""))
    return F.struct(
        slide_of(name).alias("slide"),
        _number(F.regexp_extract(plain, r"sample(\d+)", 1)).alias("sample"),
        _number(F.regexp_extract(plain, TILE_PART, 2)).alias("tile_i"),
        _number(F.regexp_extract(plain, TILE_PART, 3)).alias("tile_j"),
        _number(F.regexp_extract(plain, r"_crop(\d+)$", 1)).alias("crop"),
        _number(F.regexp_extract(name, COPY_PREFIX, 1)).alias("copy"),
        F.regexp_replace(plain, r"_crop\d+$", "").alias("tile"),
    )


def parse_path(path: Column) -> Column:
    """struct(level, fold, kind, name, ext) of `root/{wsi,tiles}/{fold}/{images,labels}/file`."""
    parts = r"(wsi|tiles)/(train|val|test)/(images|labels)/([^/]+)$"
    file = F.regexp_extract(path, parts, 4)
    return F.struct(
        F.regexp_extract(path, parts, 1).alias("level"),
        F.regexp_extract(path, parts, 2).alias("fold"),
        F.regexp_extract(path, parts, 3).alias("kind"),
        stem(file).alias("name"),
        F.regexp_extract(file, r"\.([^.]+)$", 1).alias("ext"),
    )


def stain_name(name: Column, stain: str) -> Column:
    """`<base>_<anything after the stain>.<ext>` to `<base>_<STAIN>.<ext>`."""
    tag = stain.upper()
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.concat(F.split_part(name, F.lit(tag), F.lit(1)), F.lit(tag + "."), ext)


def tidy_extension(name: Column) -> Column:
    """`.tiff` and `.png` slides become `.tif`, `.mrxs.gson` becomes `.gson`."""
    return F.regexp_replace(F.regexp_replace(name, r"\.mrxs\.gson$", ".gson"), r"\.(tiff|png)$", ".tif")


def add_stain(name: Column, stain: str) -> Column:
    """`a.json` to `a_PAS.json` for annotations and slides; names that carry the stain stay."""
    tag = "_" + stain.upper()
    return F.when(name.contains(tag + "."), name).otherwise(
        F.regexp_replace(name, r"\.(json|tif)$", tag + r".$1")
    )


def drop_stain_prefix(name: Column) -> Column:
    """`PAS_x` and `HE_x` lose the text up to the first underscore."""
    stained = name.contains("PAS") | name.contains("HE")
    return F.when(stained & name.contains("_"), F.regexp_replace(name, r"^[^_]*_", "")).otherwise(name)


def crop_name(tile: Column, k: Column) -> Column:
    return F.concat(tile, F.lit("_crop"), k.cast("string"))


def copy_name(name: Column, m: Column) -> Column:
    return F.concat(F.lit("Augm_"), m.cast("string"), F.lit("_"), name)
