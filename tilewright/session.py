"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later step then needs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def spark_session(app: str = "tilewright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one, gone at exit, only where a single machine names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not single_machine(sc.master):
            raise ValueError("several machines need a shared folder: name it in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


_MADE: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; call it when no result that reads them is needed any more."""
    gone = 0
    while _MADE:
        gone += _deleted(spark, _MADE.pop())
    return gone


def discard_one(spark: SparkSession, path: str) -> bool:
    """Delete one folder that `fresh_dir` named, once nothing that is still to run reads it. Frees the disk before the job ends."""
    _MADE.remove(path)
    return _deleted(spark, path)


def _deleted(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside are deleted as it ends; otherwise they stay until its plan is collected."""
    before = spark.conf.get(_SHUFFLES, "false")
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: later passes read only the columns they need.

    Its shuffle files go as soon as it is written.
    """
    path = fresh_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df):
    """Materialise `df` in the shared folder and cut its lineage."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()
