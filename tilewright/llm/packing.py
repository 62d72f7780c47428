"""Packing tokenised documents into fixed-length sequences by linear grouping and best fit.

1. Every document becomes token pieces of at most `capacity` ids; only the piece lengths go further.
2. The counts by length (at most `capacity` numbers, whatever the corpus holds) are the whole input of the
   plan. Lengths above `small` are sorted downwards and cut into `groups` groups of equal cardinality, each
   rounded up to its longest member. Configurations of these few sizes are found by column generation
   (a fractional optimum over all patterns, priced by a knapsack), rounded down, and the few items that
   rounding leaves over are placed by best fit.
3. The actual lengths are put back in: the items of a group are numbered, so a stretch of numbers of one
   length goes to a stretch of sequences, and the room they really leave is known. Short items fill that
   room by best fit, longest first.
4. The plan is a list of stretches (length, from number, sequence), bounded by groups and capacity; tasks
   look up every piece's sequence in it, and a window over each sequence gives the offsets.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import text as tx
from tilewright.llm.store import written
from tilewright.llm.tokens import SLICE_BYTES, Encoder, pieces_of

CAPACITY = 1024
GROUPS = 128
PIVOTS = 1500


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document's ids with `end_id`, cut if longer than `capacity`."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, ids=True)
        for batch in batches:
            for row, raw, starts in tx.slices(batch.column(1), SLICE_BYTES):
                distinct, at, per_row = pieces_of(raw, starts)
                found = encode(distinct)
                size = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                begin = np.cumsum(size) - size
                count = size[at] if len(at) else np.zeros(0, np.int64)
                ids = flat[tx.spread(begin[at], count)] if len(at) else flat
                till = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(per_row))]
                out = []
                for r in range(len(per_row)):
                    own = np.append(ids[till[r] : till[r + 1]], np.uint32(end_id)).astype("<u4")
                    a, n = 0, len(own) % capacity or capacity
                    piece = 0
                    while a < len(own):
                        out.append((row + r, piece, a, n, zlib.crc32(own[a : a + n].tobytes())))
                        a, n, piece = a + n, capacity, piece + 1
                table = np.array(out, np.int64).reshape(-1, 5)
                columns = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32))]
                columns += [pa.array(np.ascontiguousarray(table[:, c])) for c in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(key, text).mapInArrow(cut, schema)


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack over all capacities)."""
    best, choice = [0.0] * (capacity + 1), [-1] * (capacity + 1)
    useful = [(int(sizes[k]), float(value[k]), int(k)) for k in np.flatnonzero(value > 1e-12)]
    for c in range(1, capacity + 1):
        top, pick = best[c - 1], -1
        for s, v, k in useful:
            if s > c:
                break
            if best[c - s] + v > top + 1e-12:
                top, pick = best[c - s] + v, k
        best[c], choice[c] = top, pick
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return best[capacity], pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over `sizes` (rising) and how often to use each: the fractional optimum, rounded down."""
    m = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand
    for _ in range(PIVOTS):
        gain, pattern = _best_pattern(sizes, inverse.sum(axis=0), capacity)
        if gain <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.full(m, np.inf)
        np.divide(amount, step, out=ratio, where=step > 1e-9)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    return [(basis[:, k].astype(int), int(amount[k] + 1e-9)) for k in range(m) if amount[k] + 1e-9 >= 1]


class _Room:
    """Stretches of sequences by the room they have left."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            if room not in self.runs:
                insort(self.sizes, room)
                self.runs[room] = []
            self.runs[room].append((first, count))

    def tightest(self, need: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.sizes, need)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        first, count = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.sizes[at]
        return room, first, count


def _best_fit(room: _Room, length: int, count: int, number: int, opened: int, capacity: int, runs: list) -> int:
    """Place `count` items of one length, numbered from `number`; returns the number of sequences in use."""
    while count:
        found = room.tightest(length)
        if found is None:
            each = capacity // length
            found = (capacity, opened, -(-count // each))
            opened += found[2]
        left, first, n = found
        used = min(n, count)
        runs.append((length, number, used, first))
        room.add(left - length, first, used)
        room.add(left, first + used, n - used)
        number, count = number + used, count - used
    return opened


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, int, int, int]]:
    """Runs (length, first number, count, first sequence): item `number + i` of that length goes to `sequence + i`."""
    small = capacity // 8 if small is None else small
    large = sorted((s for s in counts if s > small and counts[s]), reverse=True)
    total = sum(counts[s] for s in large)
    runs: list[tuple[int, int, int, int]] = []
    room, opened = _Room(), 0
    if total:
        # Items of equal length stand together, so a group is a stretch of the sorted items.
        per_group = -(-total // groups)
        rounded: dict[int, list[tuple[int, int, int]]] = {}  # size of the group -> (length, first number, count)
        seen, size = 0, large[0]
        for s in large:
            done = 0
            while done < counts[s]:
                if seen % per_group == 0:
                    size = s
                n = min(counts[s] - done, per_group - seen % per_group)
                rounded.setdefault(size, []).append((s, done, n))
                done, seen = done + n, seen + n
        sizes = np.array(sorted(rounded))
        demand = np.array([sum(n for _, _, n in rounded[s]) for s in sizes], float)
        queue = {s: list(reversed(rounded[s])) for s in rounded}
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [int(sizes[k]) for k in range(len(sizes)) for _ in range(pattern[k])]
            stretches = [(opened, times, capacity)]
            opened += times
            for s in slots:  # substitute actual items, splitting the sequences where the length changes
                after = []
                for first, n, left in stretches:
                    while n:
                        if not queue[s]:  # the pattern asks for more than there is
                            after.append((first, n, left))
                            break
                        length, number, have = queue[s].pop()
                        used = min(n, have)
                        runs.append((length, number, used, first))
                        if have > used:
                            queue[s].append((length, number + used, have - used))
                        after.append((first, used, left - length))
                        first, n = first + used, n - used
                stretches = after
            for first, n, left in stretches:
                room.add(left, first, n)
        rest = sorted((x for s in queue for x in queue[s]), reverse=True)
        for length, number, n in rest:
            opened = _best_fit(room, length, n, number, opened, capacity, runs)
    for s in sorted((s for s in counts if s <= small and counts[s]), reverse=True):
        opened = _best_fit(room, s, counts[s], 0, opened, capacity, runs)
    return sorted(runs)


def numbered(pieces: DataFrame, rows: int, per_bucket: int = 4000) -> DataFrame:
    """Number the pieces of each length from 0 without sorting a length in one task: hashed buckets, then offsets.

    A length with a third of all pieces is dealt over as many buckets as the whole table has; the counts of
    the buckets before give each bucket's offset.
    """
    buckets = max(1, rows // per_bucket)
    cut = pieces.withColumn("_b", F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("key", "piece", "ids_crc32")
    ranked = cut.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(before, ["length", "_b"]).withColumn("_number", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def pack(
    docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, groups: int = GROUPS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): each piece's place in as few sequences as it can.

    A null or empty text is the single id `end_id`. Repeated rows are packed as often as they occur; a null
    key stays null; other columns are ignored; an empty table gives no rows. Only texts longer than
    `capacity` are cut, their first piece being the shorter one.
    """
    pieces = written(token_pieces(docs, path, end_id, capacity, key, text), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(plan(counts, capacity, groups), np.int64).reshape(-1, 4)
    names = ["key", "piece", "start", "length", "ids_crc32", "sequence_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(order, length << 44 | number, "right") - 1
            where = runs[at, 3] + number - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where)], names)

    kind = docs.schema[key].dataType.simpleString()
    rows = numbered(pieces, sum(counts.values())).select("key", "piece", "start", "length", "ids_crc32", "_number")
    placed = rows.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return out.withColumnRenamed("key", key)
