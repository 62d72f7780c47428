"""Live status of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import fresh_dir


def run_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def status_updates(runs: DataFrame) -> DataFrame:
    """Current status per experiment, in update mode. State is one row per experiment; no entry is too late."""
    last = F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id"))
    return (
        runs.groupBy("exp").agg(last.alias("_l"), F.min("ts").alias("started"))
        .select("exp", "_l.status", F.col("_l.ts").alias("updated"), F.col("_l.event_id").alias("event_id"), "started")
    )


def status_counts(runs: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Entries per status and time window, in append mode: a window comes out once it is closed for late rows."""
    return (
        runs.withWatermark("ts", late).groupBy(F.window("ts", width).alias("_w"), "status").agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("start"), "status", "n")
    )


def _drain(stream: DataFrame, mode: str, out: str, state: str) -> DataFrame:
    """Run what has arrived through `stream`; every micro-batch has a directory of its own, b = -1 is empty."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(-1)).write.mode("overwrite").parquet(f"{out}/b=-1")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/b=*")


def _micros(span: str) -> Column:
    return F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {span})")


def count_arrivals(arriving: DataFrame, out: str, state: str, late: str = "1 day", width: str = "1 day") -> None:
    """Enter what has arrived into the ledger at `out`: entries per status and window, those that came too late apart.

    An entry is too late when its window closed before its micro-batch: the window's end is not after the
    newest time of all earlier batches less `late`. This is the rule by which a watermark drops rows; here they are
    counted. A batch writes its counts and the newest time so far to directories of its own, and reads only the
    newest time its predecessor wrote, so a batch that is run again comes out the same and nothing grows but one
    small file a batch. Entries without a time have a null window and are never late.
    """
    spark = arriving.sparkSession
    empty = f"{out}/marks/b=-1"
    spark.createDataFrame([], "newest timestamp").write.mode("overwrite").parquet(empty)

    def enter(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema("newest timestamp").parquet(f"{out}/marks/b={batch_id - 1}")
        start = F.timestamp_micros(F.floor(F.unix_micros("ts") / _micros(width)).cast("bigint") * _micros(width))
        sizes = batch.groupBy(start.alias("start"), "status").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
        closed = F.unix_micros("start") + _micros(width) <= F.unix_micros(F.col("before")) - _micros(late)
        counted = sizes.withColumn("before", before.agg(F.max("newest").alias("newest")).scalar())
        flagged = counted.select("start", "status", "n", F.coalesce(closed, F.lit(False)).alias("is_late"), "newest")
        flagged.write.mode("overwrite").parquet(f"{out}/counts/b={batch_id}")
        # From what was written, so that the batch is read once.
        seen = spark.read.schema(flagged.schema).parquet(f"{out}/counts/b={batch_id}").select("newest").unionByName(before)
        seen.agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/b={batch_id}")

    query = arriving.writeStream.foreachBatch(enter).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def arrival_counts(spark: SparkSession, out: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, status, n, n_late, closed) of the ledger at `out`; n + n_late are all entries that arrived."""
    schema = "start timestamp, status string, n bigint, is_late boolean, newest timestamp, b int"
    empty = spark.createDataFrame([], schema)
    rows = empty
    if spark.read.schema("newest timestamp, b int").parquet(f"{out}/marks").filter("b >= 0").limit(1).count():
        rows = spark.read.schema(schema).option("basePath", f"{out}/counts").parquet(f"{out}/counts")
    newest = rows.agg(F.max("newest").alias("newest")).scalar()
    closed = F.unix_micros("start") + _micros(width) <= F.unix_micros(newest) - _micros(late)
    parts = {name: F.sum(F.when(F.col("is_late") == flag, F.col("n")).otherwise(0)).alias(name) for name, flag in (("n", False), ("n_late", True))}
    return rows.groupBy("start", "status").agg(*parts.values()).withColumn("closed", F.coalesce(closed, F.lit(False)))


def status_count_table(spark: SparkSession, path: str, schema: str, shape, late: str = "1 day", width: str = "1 day", files_per_batch: int = 100) -> DataFrame:
    """Drain what has arrived under `path`: (start, status, n, n_late) of the windows that are closed for late entries."""
    out = fresh_dir(spark, "run-counts")
    count_arrivals(shape(run_log(spark, path, schema, files_per_batch)), out, fresh_dir(spark, "run-counts-state"), late, width)
    return arrival_counts(spark, out, late, width).filter("closed").drop("closed")


def run_status_table(spark: SparkSession, path: str, schema: str, shape) -> DataFrame:
    """Drain what has arrived under `path` and return the status table; nothing arrived gives no rows.

    Every micro-batch writes its updates to its own directory, so a batch that is run again overwrites
    itself; the newest update per experiment is the status.
    """
    updates = status_updates(shape(run_log(spark, path, schema)))
    rows = _drain(updates, "update", fresh_dir(spark, "run-status"), fresh_dir(spark, "run-status-state"))
    last = rows.groupBy("exp").agg(F.max_by(F.struct("status", "started", "updated"), "batch").alias("_l"))
    return last.select("exp", "_l.status", "_l.started", "_l.updated")
