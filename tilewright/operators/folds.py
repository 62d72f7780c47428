"""Cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ranks import global_rank


def contiguous_folds(names: DataFrame, key: str, k: int) -> DataFrame:
    """Sorted names cut at int(linspace(0, n, k+1)): name r of n (from 1) is in fold (k·r − 1) div n."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = global_rank(names.select(key).distinct(), [key])
    n = ranked.agg(F.max("rank")).scalar()
    return ranked.select(key, F.floor((F.col("rank") * k - 1) / n).cast("int").alias("fold_n"))


def rotations(folds: DataFrame, k: int) -> DataFrame:
    """Split i of k: fold i is val, the others train."""
    rows = folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("fold", F.when(F.col("split") == F.col("fold_n"), "val").otherwise("train"))


def grouped_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """All rows of a slide share its fold."""
    return df.join(contiguous_folds(df, key, k), key)


def fold_balance(df: DataFrame, k: int, by: str = "class") -> DataFrame:
    """Rows per split, fold and class. Counted per fold first, so the rotations repeat counts, not rows."""
    counts = df.groupBy("fold_n", by).agg(F.count("*").alias("n"))
    return rotations(counts, k).groupBy("split", "fold", by).agg(F.sum("n").alias("n"))


def leaks(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Keys that occur both in train and in val. Copies are counted map-side, never gathered."""
    n = lambda name: F.count_if(F.col(fold) == name).alias(f"n_{name}")
    return df.groupBy(key).agg(n("train"), n("val")).filter("n_train > 0 and n_val > 0")
