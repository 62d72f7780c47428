"""Merging two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_datasets(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both the first dataset's row stays."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def merge_gap(first: DataFrame, second: DataFrame, merged: DataFrame, slack: int = 6) -> DataFrame:
    """One row: sizes and whether the merged one is within `slack` of the sum."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    row = n(first).withColumnRenamed("n", "n_first").withColumns({"n_second": n(second).scalar(), "n_merged": n(merged).scalar()})
    return row.withColumn("ok", F.abs(F.col("n_first") + F.col("n_second") - F.col("n_merged")) < slack)


def merge_dims(first: DataFrame, second: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Tile counts of both maps; the second map wins."""
    tagged = first.select(key, *dims, F.lit(0).alias("_s")).unionByName(second.select(key, *dims, F.lit(1).alias("_s")))
    kept = tagged.groupBy(key).agg(F.max_by(F.struct(*dims), "_s").alias("_d"))
    return kept.select(key, *[F.col(f"_d.{d}").alias(d) for d in dims])
