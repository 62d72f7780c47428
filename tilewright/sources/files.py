"""Dataset trees, label files, training metrics, clinical tables, feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import let
from tilewright.functions import names, once
from tilewright.sources.layout import write_bucketed
from tilewright.sources.listing import tree_files


def manifest_rows(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """Paths of a dataset tree as key columns, all folds. A ready inventory table can be given as `files`."""
    rows = files.withColumn("_p", names.parse_path(F.col(path))).filter("_p.fold <> ''")
    key = names.parse_name(F.col("_p.name"))
    return rows.withColumn("_k", key).select(
        "_p.level", "_p.fold", "_p.kind", "_p.name", "_p.ext", F.col(size).alias("size"),
        "_k.slide", "_k.sample", "_k.tile_i", "_k.tile_j",
    )


def dataset_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file below `root/{wsi,tiles}/{fold}/{images,labels}` whose name fits `glob`. Tasks list one directory each, and open no file."""
    pattern = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in glob)
    name = F.element_at(F.split("path", "/"), -1)
    return manifest_rows(tree_files(spark, root).filter(name.rlike(f"^{pattern}$")))


def label_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Text of label files to rows: class, and 4 (box) or more (outline) numbers. The class is the first token."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_n", "line"))
    rows = once(lines, "_t", F.split(F.trim("line"), r"\s+"), lambda t: F.get(t, 0) != "")
    numbers = F.transform(F.slice("_t", 2, F.size("_t")), lambda t: t.cast("double"))
    return rows.select(*keys, "line_n", F.get("_t", 0).cast("double").cast("int").alias("class"), numbers.alias("numbers"))


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, line_n, class, numbers) of every label file under a path or glob."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return label_lines(whole.select(names.stem(F.col("_metadata.file_name")).alias("name"), "value"), "value", "name")


def label_line(cid: Column, *numbers: Column) -> Column:
    return F.concat_ws(" ", cid.cast("string"), *[n.cast("string") for n in numbers])


def write_labels(df: DataFrame, path: str, line: Column, buckets: int | None = None) -> None:
    """Label lines as a table (fold, tile, obj, line), one directory per fold.

    Lines stay rows: a text file per tile would be millions of tiny files. The rebalance hint gives
    evenly sized files and splits a fold that is much larger than the others. With `buckets` the lines are
    hashed by tile instead (`layout`), for joins with tiles that are stored alike.
    """
    rows = df.select("fold", "tile", "obj", line.alias("line"))
    if buckets is not None:
        write_bucketed(rows, path, ["tile"], buckets, ["fold"])
        return
    rows.hint("rebalance", "fold").sortWithinPartitions("fold", "tile", "obj").write.mode("overwrite").partitionBy("fold").parquet(path)


def write_label_text(df: DataFrame, path: str, line: Column) -> None:
    """Label lines as text, `fold=<fold>/` files of lines `<tile> <obj> <label line>`: many tiles share a file."""
    value = F.concat_ws(" ", F.col("tile").cast("string"), F.col("obj").cast("string"), line)
    df.select("fold", value.alias("value")).hint("rebalance", "fold").write.partitionBy("fold").text(path)


def read_label_text(spark: SparkSession, path: str) -> DataFrame:
    """(fold, tile, line_n, class, numbers) from such files; line_n counts a tile's lines from 0 in object order."""
    raw = spark.read.schema("value string, fold string").text(path)
    tokens = F.split("value", " ")
    rows = raw.select("fold", F.get(tokens, 0).alias("tile"), F.get(tokens, 1).cast("bigint").alias("_o"), F.array_join(F.slice(tokens, 3, F.size(tokens)), " ").alias("_t"))
    lines = label_lines(rows, "_t", "fold", "tile", "_o").drop("line_n")
    in_tile = Window.partitionBy("fold", "tile").orderBy("_o")
    return lines.withColumn("line_n", F.row_number().over(in_tile) - 1).select("fold", "tile", "line_n", "class", "numbers")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("tile bigint, obj bigint, line string, fold string").parquet(path)
    tokens = F.split("line", " ")
    return rows.select(
        "fold", "tile", "obj", F.get(tokens, 0).cast("int").alias("class"),
        F.transform(F.slice(tokens, 2, F.size(tokens)), lambda t: t.cast("double")).alias("numbers"),
    )


def write_split_dataset(df: DataFrame, path: str, buckets: int | None = None, key: str = "tile") -> None:
    """A dataset by fold and class; later reads of one fold or class open only its directories.

    With `buckets` the rows of a directory are hashed by `key`, so that joins on it need no shuffle (`layout`).
    """
    if buckets is not None:
        write_bucketed(df, path, [key], buckets, ["fold", "class"])
        return
    df.hint("rebalance", "fold", "class").write.mode("overwrite").partitionBy("fold", "class").parquet(path)


def training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """results.csv of every experiment directory: doubles, `exp` = parent directory.

    Every file is read by its own header, trimmed; a column that a file lacks is null. A file holds one
    experiment's epochs, so it is read whole; the header names collected here are the few metrics there are.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    exp = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    cells = lambda line: F.transform(F.split(line, ",", -1), lambda c: F.trim(F.translate(c, "\t\r", "")))
    lines = raw.select(exp.alias("exp"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("_l")).filter(F.size("_l") > 0)
    heads = lines.select("exp", cells(F.get("_l", 0)).alias("_h"), "_l")
    names_ = sorted(r[0] for r in heads.select(F.explode("_h")).distinct().collect())
    rows = heads.select("exp", "_h", F.explode(F.slice("_l", 2, F.size("_l"))).alias("_v")).withColumn("_v", cells(F.col("_v")))
    at = lambda c: F.get("_v", (F.array_position("_h", c) - 1).cast("int"))
    value = lambda c: F.when(F.array_contains("_h", c), at(c).try_cast("double"))
    return rows.select("exp", *[value(c).alias(c) for c in names_])


def clinical_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per patient; the first, unnamed column is the id. Numbers are cast, not inferred."""
    raw = spark.read.csv(path, header=True)
    first, *rest = raw.columns
    kind = lambda c: "int" if c == "label" else "double"
    return raw.select(F.col(f"`{first}`").cast("bigint").alias("id"), *[F.col(f"`{c}`").cast(kind(c)).alias(c) for c in rest])


def feature_table(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(instance, embedding): one float vector per crop."""
    return df.select(F.col(key).alias("instance"), F.col(vector).cast("array<float>").alias("embedding"))


def boxes_of_lines(rows: DataFrame) -> DataFrame:
    """Label rows to centre-form boxes; outlines become their bounding box."""
    outline = let(g.polygon_box(g.polygon_from_numbers(F.col("numbers"))), lambda b: F.struct(b["xc"], b["yc"], b["w"], b["h"]))
    box = F.when(F.size("numbers").isin(4, 8), g.box_from_numbers(F.col("numbers"))).otherwise(outline)
    kept = [c for c in rows.columns if c != "numbers"]
    return once(rows, "_b", box).select(*kept, "_b.xc", "_b.yc", "_b.w", "_b.h")
