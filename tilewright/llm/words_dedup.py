"""Substring dedup over words by compressed FM-indexes, one per shard.

Segments that share an anchor (see `repeats`) are joined into shards. A shard's index is built over symbols of
`block` words: from every word on, the segment is read in strides of a block, so a window of `size` words is
size / block symbols wherever it starts. The segments are then streamed through the index: the matching
statistic of every word is found by backward search, and words whose statistic reaches the window size report
the interval of their window, that is all places in the shard where it starts. The earliest of them stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import repeats, text as tx
from tilewright.llm.fm_index import FMIndex

SIZE = 20
GRAM = 4
BLOCK = 5


def _block_symbols(bodies: list[bytes], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of the `block` words from each word on, or 0 where the segment ends before, words before each segment)."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.append(0, np.cumsum([len(b) for b in bodies])).astype(np.int64)
    first, end, before = tx.words(raw, starts)
    code = tx.word_codes(raw, first, end)
    symbol = np.zeros(len(code), np.int64)
    if len(code) >= block:
        row = tx.row_of(before)
        inside = np.flatnonzero(row[block - 1 :] == row[: len(row) - block + 1])
        symbol[inside] = np.unique(tx.Rolling(code).grams(block)[inside], return_inverse=True)[1] + 1
    return symbol, before


def later_in_shard(bodies: list[bytes], doc: np.ndarray, at: np.ndarray, n: np.ndarray, size: int, block: int) -> np.ndarray:
    """For the windows of all segments in order: does an equal one start earlier (smaller doc, then place)?"""
    symbol, before = _block_symbols(bodies, block)
    words = np.diff(before)
    steps = size // block
    # The indexed text: each segment once per phase, in strides of a block, then an end.
    segment, phase = np.repeat(np.arange(len(bodies)), block), np.tile(np.arange(block), len(bodies))
    strides = np.maximum(0, (words[segment] - block - phase) // block + 1)
    ends = np.cumsum(strides + 1)
    place = np.full(int(ends[-1]), -1, np.int64)
    slots = tx.spread(ends - strides - 1, strides)
    number = slots - np.repeat(ends - strides - 1, strides)
    place[slots] = np.repeat(before[segment] + phase, strides) + number * block
    text = np.where(place >= 0, symbol[place], 0)
    index = FMIndex(text, steps)
    window = tx.spread(before[:-1], n)
    read = np.stack([symbol[window + k * block] for k in range(steps)], axis=1)
    reach, lo, hi = index.matching(read, steps)
    assert (reach == steps).all()  # each window is in the index itself
    # Places by document and position; the smallest of an interval is where the window starts first.
    owner = np.repeat(np.arange(len(bodies)), words)
    by = np.lexsort((at[owner] + np.arange(len(owner)) - before[owner], doc[owner]))
    turn = np.empty(len(owner), np.int64)
    turn[by] = np.arange(len(owner))
    found = np.where(place[index.order] >= 0, turn[place[index.order]], np.iinfo(np.int64).max)
    unique, back = np.unique(lo, return_inverse=True)
    until = np.zeros(len(unique), np.int64)
    until[back] = hi
    earliest = np.minimum.reduceat(np.append(found, np.iinfo(np.int64).max), np.stack([unique, until], axis=1).ravel())[::2]
    return turn[window] != earliest[back]


def dedup_words(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, block: int = BLOCK, crowd: int = repeats.CROWD, shard_bytes: int = repeats.SHARD_BYTES,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept): each text without the words of windows seen earlier.

    A word goes if a window of `size` words that covers it also starts earlier: in a document with a smaller key,
    or earlier in the same one. kept holds the remaining words, joined by single spaces; a null or empty text has
    none. Rows that repeat a key are one document and should have the same text: what is found in one goes from
    all. Nothing goes from rows with a null key. The key must be an integer and `size` a multiple of `block`; other
    columns are ignored; an empty table gives no rows.
    """
    if size % block:
        raise ValueError("size must be a multiple of block")
    own = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))

    def search(bodies, doc, at, n, role):
        return later_in_shard(bodies, doc, at, n, size, block)

    gone = repeats.repeated_windows(own, True, size, gram, search, True, crowd, shard_bytes)
    names = ["doc", "n_words", "n_removed", "kept_sha256", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                words = (batch.column(1)[i].as_py() or "").encode().split()
                at, n = (batch.column(c)[i].values for c in (2, 3))
                total = len(words)
                if at is not None:
                    off = repeats.cover(at.to_numpy(), n.to_numpy(), size, total)
                    words = [words[k] for k in np.flatnonzero(~off).tolist()]
                kept = b" ".join(words)
                out.append((doc, total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    done = repeats.with_stretches(own, gone).mapInArrow(cut, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), *names[1:])
