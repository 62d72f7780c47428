"""Label files as they arrive: each line of a file is taken once, however often the file is delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import let, names
from tilewright.operators.labels import first_lines, lines_of

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def label_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
        .text(path, wholetext=True, pathGlobFilter="*.txt")
    )
    return raw.select(names.stem(F.col("_metadata.file_name")).alias("name"), "value")


def _first_of_text(text: Column) -> Column:
    """(line, pos) of the first occurrence of every line of a text: sorted, each but the first of equal lines dropped."""
    entries = F.transform(F.split(text, "\n"), lambda line, pos: F.struct(line.alias("line"), pos.cast("int").alias("pos")))
    return let(F.array_sort(entries), lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["line"] != e["line"])))


def ingest(files: DataFrame, text: str, key: str, out: str, state: str, within: str = "30 days") -> None:
    """Append the first occurrence of every line of every arriving file to the table at `out`.

    A file may come again, whole or with more lines, in the same batch or up to `within` later: its known lines are
    dropped by (key, line), which the state store remembers for that long from their arrival. The store is RocksDB, so
    that it need not fit in memory, and holds a hash in place of the line. Arrival is the batch's time, so nothing
    is ever too late. Of deliveries that differ and come in one batch, either gives a common line its position.
    A repeated batch overwrites its directory.
    """
    spark = files.sparkSession
    first_lines(lines_of(spark.createDataFrame([], files.schema), text, key), key).write.mode("overwrite").parquet(f"{out}/batch=-1")
    found = files.select(key, F.inline(_first_of_text(F.col(text)))).withColumns({"arrived": F.current_timestamp(), "_h": F.unhex(F.md5("line"))})
    new = found.withWatermark("arrived", within).dropDuplicatesWithinWatermark([key, "_h"]).select(key, "line", "pos")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = new.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    query.awaitTermination()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
