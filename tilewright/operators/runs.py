"""The run log and training curves. The log is append-only: (exp, event_id, ts, status, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns of the run log.
LOG_COLUMNS = [
    "datetime", "status", "duration", "exp_fold", "dataset", "batch_size", "task", "map_classes", "epochs",
    "tile_size", "image_size", "weights", "device", "data_folder", "crossvalidation", "tot_kfolds", "cur_kfold", "note",
]


def latest_run(runs: DataFrame) -> DataFrame:
    """The experiment with the newest entry."""
    return runs.agg(F.max_by("exp", F.struct("ts", "event_id")).alias("exp"), F.max("ts").alias("ts"))


def latest_runs(runs: DataFrame, n: int = 3) -> DataFrame:
    """The n experiments that were created last."""
    born = runs.groupBy("exp").agg(F.min("ts").alias("created"))
    return born.orderBy(F.desc("created"), F.desc("exp")).limit(n)


def run_status(runs: DataFrame) -> DataFrame:
    """Current status per experiment, and the time since its first entry."""
    last = F.max_by("status", F.struct("ts", "event_id")).alias("status")
    return runs.groupBy("exp").agg(last, F.min("ts").alias("started"), F.max("ts").alias("updated")).withColumn(
        "seconds", F.unix_seconds("updated") - F.unix_seconds("started")
    )


def training_status(seconds: Column) -> Column:
    """`<1min` for trainings under a minute in all."""
    return F.when(seconds < 60, "<1min").otherwise("completed")


def best_epoch(curve: DataFrame, metric: str = "value") -> DataFrame:
    """Epoch with the highest metric, the first one on a tie."""
    return curve.groupBy("exp").agg(
        F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("epoch"), F.max(metric).alias(metric)
    )


def best_so_far(curve: DataFrame, metric: str = "value", slice_epochs: int = 4096) -> DataFrame:
    """Epochs at which the metric rose above everything before: when a checkpoint would have been written.

    The running maximum is taken inside slices of epochs and carried over by the slices' maxima, so a very
    long curve is not one task's work.
    """
    cut = curve.withColumn("_s", F.floor(F.col("epoch") / slice_epochs))
    tops = cut.groupBy("exp", "_s").agg(F.max(metric).alias("_top"))
    earlier = Window.partitionBy("exp").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("exp", "_s", F.max("_top").over(earlier).alias("_top"))
    inside = Window.partitionBy("exp", "_s").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.repartition("exp", "_s").withColumn("_in", F.max(metric).over(inside)).join(tops, ["exp", "_s"])
    best = F.greatest("_top", "_in")  # nulls are skipped
    return seen.filter(best.isNull() | (F.col(metric) > best)).drop("_s", "_top", "_in")


def learning_curve(curve: DataFrame, columns: list[str]) -> DataFrame:
    return curve.select("exp", "epoch", *columns).orderBy("exp", "epoch")


def append_run(log: DataFrame, row: DataFrame, columns: list[str] = LOG_COLUMNS) -> DataFrame:
    """The log with more rows: known columns only, as text; what a row lacks is null."""
    def text(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])

    return text(log).unionByName(text(row))
