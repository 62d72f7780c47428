"""Periodic runs of words, located by block convolution.

At the scale of distance D, a power of two, every D-th word begins a block of min(D, 1024) words. The sums of
squared differences between a block and all places at distances D to 2D - 1 are one convolution, computed exactly by
a number-theoretic transform; where a sum is zero the block stands again. A run that repeats with a period q of D to
2D - 1 at least three times holds a block and its copy at distance q, so every run has a seed. Seeds are
extended both ways over words that stand again q words later. The smallest scale takes all distances below 16.

A block's words are numbered 1 to 1024 within the block and other words count as 0, so that a sum is at most 2**30,
below the prime: zero modulo the prime is zero. Blocks are not transformed where they cannot matter: one with a word
that does not come again within the scale's reach has no copy, and what lies with its whole reach in a run of a period
no longer than the block has that period, hence no new smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm import text as tx

SMALLEST = 8
LARGEST_BLOCK = 1024
CHUNK = 1 << 18  # numbers that are transformed at once

# The prime 15 * 2**27 + 1 and a generator of its multiplicative group.
PRIME = 2013265921
GENERATOR = 31

_P = np.uint64(PRIME)


@cache
def _twiddles(half: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(half, np.uint64)
    filled = 1
    while filled < half:
        out[filled : 2 * filled] = out[:filled] * np.uint64(pow(root, filled, PRIME)) % _P
        filled *= 2
    return out


def _transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order; `x` is overwritten."""
    rows, n = x.shape
    half = n // 2
    while half:
        pair = x.reshape(rows, n // (2 * half), 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        lower = (a + (_P - b)) * _twiddles(half, False) % _P
        a += b
        np.subtract(a, _P, out=a, where=a >= _P)
        pair[:, :, 1] = lower
        half //= 2
    return x


def _inverse(x: np.ndarray) -> np.ndarray:
    """The rows whose transform, in bit-reversed order, is `x`, times their length; `x` is overwritten."""
    rows, n = x.shape
    half = 1
    while half < n:
        pair = x.reshape(rows, n // (2 * half), 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1] * _twiddles(half, True) % _P
        pair[:, :, 1] = a + (_P - b)
        a += b
        for side in (a, pair[:, :, 1]):
            np.subtract(side, _P, out=side, where=side >= _P)
        half *= 2
    return x


def zero_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each row of `blocks` (B numbers, B at most 1024) stands in the same row of `windows` (2B): offsets 0 to B - 1, as flags."""
    rows, size = blocks.shape
    n = np.uint64(2 * size)
    span = np.int64(max(int(blocks.max()), int(windows.max())) + 1)
    base = np.arange(rows, dtype=np.int64)[:, None] * span
    ordered = np.sort(blocks + base, axis=1).ravel()
    first = np.arange(rows)[:, None] * size - 1
    x = (np.searchsorted(ordered, (blocks + base).ravel()).reshape(rows, size) - first).astype(np.uint64)
    at = np.searchsorted(ordered, (windows + base).ravel())
    known = ordered[np.minimum(at, len(ordered) - 1)].reshape(windows.shape) == windows + base
    y = np.where(known, at.reshape(windows.shape) - first, 0).astype(np.uint64)
    own = (x * x).sum(axis=1, dtype=np.uint64)[:, None]
    squares = np.zeros((rows, 2 * size + 1), np.uint64)
    np.cumsum(y * y, axis=1, out=squares[:, 1:])
    within = squares[:, size : 2 * size] - squares[:, :size]
    mirrored = np.zeros_like(y)
    mirrored[:, 0] = x[:, 0]
    mirrored[:, : size : -1] = x[:, 1:]
    product = _inverse(_transform(mirrored) * _transform(y) % _P)
    return (own + within) * n % _P == np.uint64(2) * product[:, :size] % _P


def _reach(rolling: tx.Rolling, x: np.ndarray, y: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x on equal those from y on (before x and y, if `back`), at most `room`."""
    found = np.zeros(len(x), np.int64)
    step = 1 << int(room.max(initial=0)).bit_length()
    while step:
        more = found + step
        fits = np.flatnonzero(more <= room)
        k, a, b = more[fits], x[fits], y[fits]
        same = rolling(a - k, a) == rolling(b - k, b) if back else rolling(a, a + k) == rolling(b, b + k)
        found[fits[same]] = k[same]
        step //= 2
    return found


def _next_same(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distance to the next place of the same word in the same row; very large where there is none."""
    order = np.lexsort((row, word))
    out = np.full(len(word), np.iinfo(np.int64).max)
    same = (word[order[1:]] == word[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(word: np.ndarray, row: np.ndarray, before: np.ndarray, soon: np.ndarray, scale: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the blocks of a scale that stand again at one of its distances."""
    size = min(scale, LARGEST_BLOCK)
    nearest = 1 if scale == SMALLEST else scale
    words = np.diff(before)
    count = np.where(words >= 3 * scale, np.maximum(0, (words - size - nearest) // scale + 1), 0)
    place = np.repeat(before[:-1], count) + (tx.spread(np.zeros_like(count), count)) * scale
    stop = np.repeat(before[1:], count)
    far = np.append(0, np.cumsum(soon >= 2 * scale))
    use = far[place + size] == far[place]
    known = runs[runs[:, 2] <= size]
    if len(known):
        known = known[np.argsort(known[:, 0], kind="stable")]
        ends = np.maximum.accumulate(known[:, 1])
        at = np.searchsorted(known[:, 0], place, "right") - 1
        use &= (at < 0) | (ends[at] < np.minimum(place + 2 * scale + size, stop))
    place, stop = place[use], stop[use]
    starts = np.arange(0 if scale == SMALLEST else scale, 2 * scale, size)
    block, offset = np.repeat(np.arange(len(place)), len(starts)), np.tile(starts, len(place))
    fits = place[block] + offset + size <= stop[block]
    block, offset = block[fits], offset[fits]
    found = [(np.zeros(0, np.int64),) * 2]
    per = max(1, CHUNK // (2 * size))
    for lo in range(0, len(block), per):
        b, o = block[lo : lo + per], offset[lo : lo + per]
        inside = place[b][:, None] + o[:, None] + np.arange(2 * size)
        windows = np.where(inside < stop[b][:, None], word[np.minimum(inside, len(word) - 1)], -1)
        hit, at = np.nonzero(zero_mismatch(word[place[b][:, None] + np.arange(size)] + 1, windows + 1))
        found.append((place[b[hit]], o[hit] + at))
    place, distance = (np.concatenate(c) for c in zip(*found))
    return place[distance > 0], distance[distance > 0]


def find_runs(code: np.ndarray, before: np.ndarray, min_length: int = 24, min_times: int = 3) -> np.ndarray:
    """(start, end, period) of all runs of the rows' word codes, as places in `code`, by start and period.

    Row r has the words before[r] to before[r + 1]. A run is a stretch of words with smallest period q, of at least
    min_length words and min_times (3 or more) periods, that no word next to it in its row extends.
    """
    if min_length < 3 * SMALLEST or min_times < 3:
        raise ValueError(f"runs are found from {3 * SMALLEST} words and three periods on")
    runs = np.zeros((0, 3), np.int64)
    longest = int(np.diff(before).max(initial=0))
    if longest < min_length:
        return runs
    word = np.unique(code, return_inverse=True)[1].astype(np.int64)
    row = tx.row_of(before)
    soon = _next_same(word, row)
    rolling = tx.Rolling(code)
    scale = SMALLEST
    while 3 * scale <= longest:
        place, period = _seeds(word, row, before, soon, scale, runs)
        size = min(scale, LARGEST_BLOCK)
        lo, hi = before[row[place]], before[row[place] + 1]
        end = place + period + size
        end = end + _reach(rolling, place + size, end, hi - end, False)
        start = place - _reach(rolling, place, place + period, place - lo, True)
        long_enough = end - start >= np.maximum(min_length, min_times * period)
        new = np.unique(np.stack([start, end, period], axis=1)[long_enough], axis=0)
        for s, e, q in new.tolist():
            if not np.array_equal(word[s : e - q], word[s + q : e]):
                raise ArithmeticError("two stretches of words have one 64-bit hash")
        # Of the periods of one stretch, the smallest; what is found again at a larger scale is a multiple.
        runs = np.concatenate([runs, new])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]]
        scale *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(raw: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The words of each row, joined by single spaces."""
    width = end - first + 1
    stop = np.cumsum(width)
    out = np.append(raw, np.uint8(0x20))[tx.spread(first, width)]
    out[stop - 1] = 0x20
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    per_row = np.bincount(row, weights=width, minlength=rows).astype(np.int64)
    per_row[row[last]] -= 1
    body = np.delete(out, stop[last] - 1)
    offsets = np.append(0, np.cumsum(per_row))
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.string())


def collapse_runs(docs: DataFrame, min_length: int = 24, min_times: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row of `docs`: its periodic runs, and its words with each run cut to one period.

    runs: array of (start, length, period), counted in words, by start and period. A word goes if any run holds it after
    the run's first period; collapsed joins the others by single spaces. Words are runs of characters other than
    space and U+0009 to U+000D. A null or empty text has no words and no runs; repeated rows are judged alike; a
    null key is kept; other columns are ignored; no documents give no rows. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, starts in tx.slices(batch.column(1)):
                rows = len(starts) - 1
                first, end, before = tx.words(raw, starts)
                runs = find_runs(tx.word_codes(raw, first, end), before, min_length, min_times) if len(first) else np.zeros((0, 3), np.int64)
                gone = np.zeros(len(first) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 1], -1)
                stays = np.cumsum(gone[:-1]) == 0
                row = tx.row_of(before)
                own = row[runs[:, 0]]
                fields = [runs[:, 0] - before[own], runs[:, 1] - runs[:, 0], runs[:, 2]]
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(f)) for f in fields], ["start", "length", "period"])
                offsets = np.append(0, np.cumsum(np.bincount(own, minlength=rows))).astype(np.int32)
                columns = [
                    batch.column(0).slice(at, rows), pa.array(np.diff(before)), pa.ListArray.from_arrays(pa.array(offsets), structs),
                    _joined(raw, first[stays], end[stays], row[stays], rows),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    schema = f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(key, text).mapInArrow(collapse, schema).withColumnRenamed("key", key)
