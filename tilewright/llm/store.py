"""Intermediate tables in the cluster's shared folder: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tilewright.session import fresh_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back; nothing is computed twice after this."""
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that `written` returned, once nothing that is still to run reads it. Frees the disk before the job ends."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
