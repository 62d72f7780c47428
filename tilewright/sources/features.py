"""Feature files: one saved float vector (`.npy`) per crop, named like the crop."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import names

# How a saved array begins, and the sizes of its header's length by format version.
MAGIC = b"\x93NUMPY"
LENGTH_BYTES = {1: 2, 2: 4, 3: 4}


class _Headers:
    """(bytes before the numbers, their type, their count) of a saved vector; equal headers are read once."""

    def __init__(self):
        self.known: dict[bytes, tuple[np.dtype, int]] = {}

    def __call__(self, body: bytes) -> tuple[int, np.dtype, int] | None:
        if body[:6] != MAGIC or len(body) < 10 or body[6] not in LENGTH_BYTES:
            return None
        size = LENGTH_BYTES[body[6]]
        end = 8 + size + int.from_bytes(body[8 : 8 + size], "little")
        head = body[:end]
        if head not in self.known:
            stream = io.BytesIO(head)
            version = np.lib.format.read_magic(stream)
            reader = np.lib.format.read_array_header_1_0 if version[0] == 1 else np.lib.format.read_array_header_2_0
            try:
                shape, _, dtype = reader(stream)
            except ValueError:
                return None
            if dtype.kind != "f" or len(shape) != 1:
                return None
            self.known[head] = (dtype, shape[0])
        dtype, count = self.known[head]
        return (end, dtype, count) if len(body) == end + count * dtype.itemsize else None


def vectors_of(df: DataFrame, content: str, *keys: str, strict: bool = True) -> DataFrame:
    """(keys, embedding): the vectors of saved one-dimensional float arrays of any width and byte order, as floats.

    What is no such array, or is cut short, is an error, or a null vector where not `strict`.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", embedding array<float>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header = _Headers()
        for batch in batches:
            parts, length = [], [0]
            gone = np.zeros(len(batch), bool)
            for k, body in enumerate(batch.column(len(keys))):
                raw = body.as_py() or b""
                found = header(raw)
                if found is None and strict:
                    raise ValueError("unreadable feature file: " + " ".join(str(batch.column(i)[k]) for i in range(len(keys))))
                gone[k] = found is None
                if found is not None:
                    parts.append(np.frombuffer(raw, found[1], found[2], found[0]).astype(np.float32))
                length.append(length[-1] + (found[2] if found else 0))
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(length, pa.int32()), values, mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], [*keys, "embedding"])

    return df.select(*keys, content).mapInArrow(decode, schema)


def feature_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(instance, embedding) of every `.npy` file below `path`; the instance is the file's name up to the first point."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    name = names.stem(F.element_at(F.split("path", "/"), -1))
    return vectors_of(raw.select(name.alias("instance"), "content"), "content", "instance", strict=strict)


def write_feature_files(df: DataFrame, path: str, key: str, vector: str) -> None:
    """One `.npy` file of 32-bit floats for each row, named by its key. `path` is a folder that all tasks reach by a scheme Arrow knows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        done = 0
        for batch in batches:
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                with files.open_output_stream(f"{base}/{name}.npy") as out:
                    np.lib.format.write_array(out, values.values.to_numpy(zero_copy_only=False).astype("<f4"), version=(1, 0), allow_pickle=False)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    df.select(F.col(key).cast("string").alias("name"), F.col(vector).cast("array<float>").alias("values")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
