"""Texts of an Arrow batch as byte arrays: slices, words, hashes. Used inside tasks; everything is vectorised.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so it is the same in UTF-8 bytes as in characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

_MIXED = 1 << 14

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x.astype(np.uint64, order="C", copy=True)
    flat = x.reshape(-1)
    spare = np.empty(min(len(flat), _MIXED), np.uint64)
    for lo in range(0, len(flat), _MIXED):  # parts that stay in the processor's cache
        part = flat[lo : lo + _MIXED]
        shifted = spare[: len(part)]
        part ^= np.right_shift(part, np.uint64(30), out=shifted)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= np.right_shift(part, np.uint64(27), out=shifted)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= np.right_shift(part, np.uint64(31), out=shifted)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n, kept for the ordinary slice size."""
    size = max(n + 1, SLICE_BYTES + 1)
    if size not in _POWERS:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > SLICE_BYTES + 1:
            return made[0], made[1]
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit codes, independent of where the stretch lies."""

    def __init__(self, codes: np.ndarray):
        self.up, self.down = _powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every stretch of k codes."""
        n = max(0, len(self.sums) - k)
        raw = (self.sums[k:] - self.sums[:n]) * self.down[:n] if n else np.zeros(0, np.uint64)
        return mix(raw + np.uint64(k))


def give_back() -> None:
    """Return freed memory to the system: a task's worker lives on, and others need the room meanwhile."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) of successive rows holding about `limit` bytes; null texts are empty.

    A row is never cut: one longer than `limit` is a slice of its own. Row r of the slice is
    bytes[starts[r]:starts[r + 1]].
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield row, raw[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last
    give_back()


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the slice, and for each row the number of words before it (rows + 1 entries)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(starts), np.int64)
    solid = ~_SPACE[raw]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(raw))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, starts)


def byte_codes(raw: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[raw]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)


def word_codes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(byte_codes(raw))(first, end)


def row_of(before: np.ndarray) -> np.ndarray:
    """Row of each word, from the counts that `words` gives."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the stretches [start, start + length), one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - length - start, length)


def anchors(order: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest entry (leftmost of equal ones) in every window of `width` entries.

    Only the upper half of each 64-bit entry is compared, so that its place fits into the lower half.
    """
    n = len(order) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (order & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:n], low[width - span : width - span + n])
    return (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
