"""Tables laid out for their joins: hashed into buckets by a key, so that joins and groups on it need no shuffle.

The files are plain Parquet and can be read as such. What the layout is stands beside them (`_layout`), so another
session can open the table with its buckets. Tables with the same key and number of buckets meet bucket by bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def buckets_for(rows: int, rows_per_bucket: int = 4_000_000) -> int:
    """A power of two, so that a table with fewer buckets can still be joined without a shuffle."""
    return 1 << max(0, -(-rows // rows_per_bucket) - 1).bit_length()


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, partitions: list[str] = ()) -> DataFrame:
    """Write `df` in `buckets` buckets by `keys`, below a directory for each value of `partitions`, and open it.

    Rows are dealt by the hash that the buckets use, so each bucket is written by one task, as one file a directory.
    """
    own = [c for c in df.columns if c not in partitions] + list(partitions)
    rows = df.select(*own)
    dealt = rows.repartition(buckets, *keys).sortWithinPartitions(*partitions, *keys)
    writer = dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    name = _name()
    (writer.partitionBy(*partitions) if partitions else writer).format("parquet").saveAsTable(name)
    layout = {"schema": rows.schema.jsonValue(), "keys": list(keys), "buckets": buckets, "partitions": list(partitions)}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by `write_bucketed`, with its buckets."""
    layout = json.loads(spark.read.text(f"{path}/_layout").first()[0])
    fields = T.StructType.fromJson(layout["schema"]).fields
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    name = _name()
    split = f"PARTITIONED BY ({quoted(layout['partitions'])})" if layout["partitions"] else ""
    keys = quoted(layout["keys"])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {split} CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    if layout["partitions"]:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _name() -> str:
    return f"tilewright_{uuid.uuid4().hex}"
