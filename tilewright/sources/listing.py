"""A dataset tree as a data source: directories are dealt to tasks, which list them.

Spark's own file sources gather the whole listing on the driver, with a status object for each file. Here the driver
sees only directories down to `depth`; each of them is one task, which returns its files in batches and opens none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint"
BATCH = 50_000


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Directory(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.depth = options["path"], int(options.get("depth", 3))

    def partitions(self) -> list[InputPartition]:
        """Directories `depth` levels down with all below them, and those above by themselves."""
        from pyarrow import fs

        files, base = _file_system(self.root)
        level, out = [base], []
        for _ in range(self.depth):
            out += [_Directory(p, False) for p in level]
            level = [f.path for p in level for f in files.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.type == fs.FileType.Directory and _shown(f.base_name)]
        return out + [_Directory(p, True) for p in level]

    def read(self, partition: _Directory) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = _file_system(self.root)
        lead = self.root.rstrip("/")
        found: list[tuple[str, int]] = []
        todo = [partition.path]
        while todo:
            for f in files.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                if not _shown(f.base_name):
                    continue
                if f.type == fs.FileType.Directory and partition.deep:
                    todo.append(f.path)
                elif f.type == fs.FileType.File:
                    found.append((lead + f.path[len(base.rstrip("/")) :], f.size))
                if len(found) == BATCH:
                    yield _batch(found)
                    found = []
        if found:
            yield _batch(found)


def _shown(name: str) -> bool:
    """Names that begin with a point or an underscore belong to writers, as for Spark."""
    return not name.startswith((".", "_"))


def _batch(found: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "length"])


class TreeListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listed_by_tasks(root: str) -> bool:
    """Whether tasks can list below `root`: its scheme is one that Arrow knows."""
    try:
        _file_system(root)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def qualified(spark: SparkSession, root: str) -> str:
    """`root` with its scheme, as Arrow writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def tree_files(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """(path, length) of every file below `root`; a root that is not there has none.

    Where only Hadoop knows the scheme of `root`, the listing is that of Spark's file source.
    """
    uri = qualified(spark, root)
    if listed_by_tasks(uri):
        spark.dataSource.register(TreeListing)
        return spark.read.format("tilewright_tree").option("depth", depth).load(uri)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
