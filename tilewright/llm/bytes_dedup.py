"""Exact substring dedup over bytes by suffix arrays.

Segments that share an anchor (see `repeats`) are joined into shards of about `shard_bytes`. A shard's suffix
array is built by induced sorting, its permuted common prefixes are computed, and a window repeats where it
shares `size` bytes with a neighbour in the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import repeats, text as tx
from tilewright.llm.suffix import common_prefixes, suffix_array

SIZE = 200
GRAM = 24
SEPARATOR = b"\xff"  # no byte of UTF-8


def repeated_in_shard(bodies: list[bytes], role: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """For the windows of all segments in order: does it occur again, in the shard or in a copy of its segment?"""
    joined = np.frombuffer(SEPARATOR.join(bodies), np.uint8)
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.cumsum(length + 1) - length - 1
    order = suffix_array(joined)
    shared, neighbour = common_prefixes(joined, order, (begin + length)[:-1])
    far = np.flatnonzero(shared >= size)
    again = np.zeros(len(joined), bool)
    again[far] = True
    again[neighbour[far]] = True
    return again[tx.spread(begin, n)] | np.repeat(role == 1, n)


def dedup_bytes(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, crowd: int = repeats.CROWD, shard_bytes: int = repeats.SHARD_BYTES,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): each text without the bytes that repeated strings cover.

    A byte goes if a `size`-byte string that covers it also starts anywhere else in the corpus, the same text
    included; all its occurrences go. Texts are UTF-8 bytes, a null one is empty. n_spans counts maximal removed
    runs; kept holds the remaining bytes. Rows that repeat a key are one document and should have the same text:
    what is found in one goes from all. Nothing goes from rows with a null key. The key must be an integer;
    other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))

    def search(bodies, doc, at, n, role):
        return repeated_in_shard(bodies, role, n, size)

    gone = repeats.repeated_windows(own, False, size, gram, search, False, crowd, shard_bytes)
    # The first of several equal segments has repeats in its copies.
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                raw = np.frombuffer((batch.column(1)[i].as_py() or "").encode(), np.uint8)
                at, n = (batch.column(c)[i].values for c in (2, 3))
                off = repeats.cover(at.to_numpy(), n.to_numpy(), size, len(raw)) if at is not None else np.zeros(len(raw), bool)
                kept = raw[~off].tobytes()
                spans = int((off & ~np.append(False, off[:-1])).sum()) if len(off) else 0
                out.append((doc, len(raw), int(off.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = repeats.with_stretches(own, gone).mapInArrow(cut, schema)
    return done.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), *names[1:])
