"""Fuzzy line dedup over a corpus by MinHash: one line is kept of each group of near-equal lines.

1. Every line with a word (without the white space around it) is cut into character shingles; one shorter than a
   shingle is one shingle, so it is matched exactly. One hash per shingle goes into one of `bands * rows` bins;
   the bins' minima are the signature, empty bins borrow from the next one (one-permutation hashing). `rows`
   minima make a band key. Lines that a task has seen before only point at the smallest of their text so far.
2. Lines with a band key in common form a group led by the smallest; two lines of similarity s share a key with
   probability 1 - (1 - s**rows) ** bands, 0.9985 at s = 0.75 with the defaults, and more above.
   Copies (by 64-bit hash) of a smaller line leave the groups, in which that line stands as well.
3. Each group's lines are compared exactly: their shingle sets, pair by pair in groups of a few lines, else by
   T-occurrence search, in one task per group; a group above `BLOCK` lines is dealt over pairs of blocks.
4. Verified links and the copies across tasks go to a distributed union-find; of each component the first line
   (smallest key, then line number) stays. Copies within a task follow the line they point at.

With 8-character shingles that do not repeat and 75 percent, lines with one replaced inner character reach the
similarity only from 63 characters on, (L - 15) / (L + 1) >= 0.75; with a replaced last character from 14 on,
(L - 8) / (L - 6) >= 0.75. Shorter lines with such a difference are not linked.

A line is numbered key * 2**24 + line, so keys below 2**39 and 16 million lines per text are the limits; a
larger one raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import text as tx
from tilewright.llm.components import components
from tilewright.llm.jaccard import PIVOTS, _led, connect
from tilewright.llm.store import written

SHINGLE = 8
BANDS = 12
ROWS = 3
PERCENT = 75
LEAST = 1  # every line with a word
BLOCK = 2000
GROUPS_PER_TASK = 2000
LINE_BITS = 24
FEW = 4  # lines of a group whose pairs are all tested
MANY = 16  # lines of a group in which bulk copies are looked for first
PROBE = 16  # list entries that are merged in the time of one probe, about
VALUES = 1 << 17  # of pairs, sorted at once
_CODES = tx.mix(np.arange(1, (1 << 11) + 1, dtype=np.uint64))  # of the characters of one or two bytes


def _trimmed(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, begin, end) of every line with a word, without white space around it."""
    first, end, _ = tx.words(raw, starts)
    rows = len(starts) - 1
    feeds = np.flatnonzero(raw == 10)
    feed_row = np.searchsorted(starts, feeds, "right") - 1
    begins = np.sort(np.concatenate([starts[:-1], feeds + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(rows), feed_row]), kind="stable")
    number = np.arange(len(line_row)) - np.searchsorted(line_row, np.arange(rows))[line_row]
    last = np.append(line_row[1:] != line_row[:-1], True)
    finish = np.where(last, starts[line_row + 1], np.append(begins[1:], 0) - 1)
    a, b = np.searchsorted(first, begins), np.searchsorted(first, finish)
    some = b > a
    return line_row[some], number[some], first[a[some]], end[b[some] - 1]


def _characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, places of the bytes that begin no character)."""
    inner = np.flatnonzero((raw & 0xC0) == 0x80)
    if not len(inner):
        return raw, inner
    return np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4"), inner


def _before(inner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of characters before each of these bytes."""
    return at - np.searchsorted(inner, at)


def _rolling(points: np.ndarray) -> tx.Rolling:
    """Hashes of any stretch of characters."""
    codes = _CODES.take(points, mode="clip")
    if points.dtype != np.uint8:
        rare = np.flatnonzero(points >= len(_CODES))
        codes[rare] = tx.mix(points[rare].astype(np.uint64) + np.uint64(1))
    return tx.Rolling(codes)


def _shingles(rolling: tx.Rolling, begin: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the k-character shingles of each line; a shorter line is one shingle. Lines follow one another."""
    count = np.maximum(1, end - begin - k + 1)
    grams = rolling.grams(k)
    edge = np.zeros(len(rolling.sums), np.int8)
    edge[begin] = 1
    edge[begin + count] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    # The last characters begin no shingle, but a line of fewer than k may begin there.
    out = np.concatenate([grams[inside[: len(grams)]], np.zeros(np.count_nonzero(inside[len(grams) :]), np.uint64)])
    short = np.flatnonzero(end - begin < k)
    out[(np.cumsum(count) - count)[short]] = rolling(begin[short], end[short])
    return out, count


def band_keys(hashes: np.ndarray, counts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) keys of the one-permutation signatures."""
    bins = bands * rows
    low = hashes & np.uint64(0xFFFFFFFF)
    at = hashes >> np.uint64(32)
    at *= np.uint64(bins)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(len(counts)) * bins, counts)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(counts) * bins, empty)
    np.minimum.at(least, at, low)
    least = least.reshape(len(counts), bins)
    filled, step = least.copy(), 0
    # Only signatures that still have empty bins go on: one line of a single shingle takes as many steps as there are bins.
    open_ = np.flatnonzero((least == empty).any(axis=1))
    while len(open_):
        step += 1
        part, moved = filled[open_], np.roll(least[open_], -step, axis=1)
        part = np.where((part == empty) & (moved != empty), moved + np.uint64(step << 32), part)
        filled[open_] = part
        open_ = open_[(part == empty).any(axis=1)]
    key = np.zeros((len(counts), bands), np.uint64)
    for r in range(rows):
        key = tx.mix(key ^ filled[:, r::rows][:, :bands])
    return tx.mix(key + np.arange(bands, dtype=np.uint64))


class Seen:
    """The smallest node of every hash met so far: sorted runs of 16 bytes a hash, merged as they grow."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def first(self, hashes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The smallest node of each hash, here or in an earlier call."""
        own, back = np.unique(hashes, return_inverse=True)
        lead = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(lead, back, node)
        fresh = np.ones(len(own), bool)
        for known, nodes in self.runs:
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            met = known[place] == own
            lead[met] = nodes[place[met]] = np.minimum(nodes[place[met]], lead[met])
            fresh &= ~met
        if fresh.any():
            self.runs.append((own[fresh], lead[fresh]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, x), (b, y) = self.runs.pop(), self.runs.pop()
            order = np.argsort(both := np.concatenate([a, b]))
            self.runs.append((both[order], np.concatenate([x, y])[order]))
        return lead[back]


def line_table(docs: DataFrame, least: int, shingle: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """A row per document (line -1, with n_lines) and per line of `least` characters: its number, the smallest
    number that the partition has met its text with so far, the text's hash, and, for the smallest, its band keys."""
    names = ["doc", "line", "node", "first", "hash", "n_lines", "keys"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids = np.array([x if x is not None else 0 for x in batch.column(0).to_pylist()], np.int64)
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if (np.abs(ids) >= 1 << 39).any():
                raise ValueError("keys must be below 2**39")
            for at, raw, starts in tx.slices(batch.column(1)):
                n = len(starts) - 1
                row, number, begin, end = _trimmed(raw, starts)
                per_doc = np.bincount(row, minlength=n)
                points, inner = _characters(raw)
                rolling = _rolling(points)
                begin, end = _before(inner, begin), _before(inner, end)
                use = valid[at + row] & (end - begin >= least)
                row, number, begin, end = row[use], number[use], begin[use], end[use]
                if (number >= 1 << LINE_BITS).any():
                    raise ValueError("a text has too many lines")
                node = (ids[at + row] << LINE_BITS) | number
                mark = rolling(begin, end)
                first = seen.first(mark, node)
                fresh = first == node
                h, count = _shingles(rolling, begin[fresh], end[fresh], shingle)
                keys = tx.signed(band_keys(h, count, bands, rows).ravel())
                m = len(node)
                columns = [
                    batch.column(0).take(pa.array(at + np.concatenate([np.arange(n), row]))).cast(pa.int64()),
                    pa.array(np.concatenate([np.full(n, -1), number]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(n, np.int64), node])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), first])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), np.where(fresh, tx.signed(mark), 0)])),
                    pa.array(np.concatenate([per_doc, np.zeros(m, np.int64)]).astype(np.int64)),
                    tx.lists(keys, np.concatenate([np.zeros(n, np.int64), np.where(fresh, bands, 0)]), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc long, line long, node long, first long, hash long, n_lines long, keys array<long>"
    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(lines, schema)


def line_twins(table: DataFrame) -> DataFrame:
    """(a, b): of the lines with keys, those that some partition has with a smaller number, and the smallest."""
    posts = table.filter("line >= 0 and node = first").select(F.col("hash").alias("k"), F.col("node").alias("doc"))
    posts = posts.repartition("k").sortWithinPartitions("k", "doc")
    return posts.mapInArrow(_led, "doc long, leader long, keys long").filter("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b"))


def _line_groups(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(task, leader, cell, node, line): each member's text, once for each group or pair of blocks."""
    wanted = members.groupBy(F.shiftright("node", LINE_BITS).alias("doc")).agg(F.collect_list(F.struct("node", "leader", "task", "blocks")).alias("at"))
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).join(wanted, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            edge, flat = lists.offsets.to_numpy(), lists.values
            for at, raw, starts in tx.slices(batch.column(0)):
                row, number, begin, end = _trimmed(raw, starts)
                places = flat.slice(edge[at], edge[at + len(starts) - 1] - edge[at])
                node, leader, task, blocks = (places.field(k).to_numpy() for k in range(4))
                owner = np.repeat(np.arange(len(starts) - 1), np.diff(edge[at : at + len(starts)]))
                want = (owner << LINE_BITS) | (node & ((1 << LINE_BITS) - 1))
                known = (row << LINE_BITS) | number
                place = np.searchsorted(known, want)
                # A line that is not there stands in another row with the same key.
                use = np.flatnonzero(np.append(known, -1)[place] == want)
                mine = np.where(blocks > 1, (tx.mix(node.view(np.uint64)) % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64), 0)
                copies = np.maximum(1, blocks[use] - 1)
                one = np.repeat(use, copies)
                other = tx.spread(np.zeros(len(use), np.int64), copies)
                other = np.where(blocks[one] > 1, other + (other >= mine[one]), 0)
                cell = np.minimum(mine[one], other) * blocks[one] + np.maximum(mine[one], other)
                lo, hi = begin[place[one]], end[place[one]]
                yield from _grouped(raw, lo, hi - lo, [task[one] + cell, leader[one], cell, node[one]])

    return texts.select("text", "at").mapInArrow(cut, "task long, leader long, cell long, node long, line binary")


def _grouped(raw: np.ndarray, start: np.ndarray, length: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns and the lines, in batches of about a slice."""
    total = np.append(0, np.cumsum(length))
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + tx.SLICE_BYTES, "right")) - 1)
        body = raw[tx.spread(start[lo:hi], length[lo:hi])]
        offsets = (total[lo : hi + 1] - total[lo]).astype(np.int32)
        lines = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        yield pa.RecordBatch.from_arrays([*[pa.array(c[lo:hi]) for c in columns], lines], ["task", "leader", "cell", "node", "line"])
        lo = hi


def _sets(lines: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle set of each line."""
    raw = np.frombuffer(b"".join(lines), np.uint8)
    edge = np.append(0, np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))))
    points, inner = _characters(raw)
    edge = _before(inner, edge)
    h, count = _shingles(_rolling(points), edge[:-1], edge[1:], k)
    at = _sorted_parts(h, count)
    new = np.append(True, h[1:] != h[:-1])
    new[at[:-1]] = True
    at = np.append(0, np.cumsum(new))[at].tolist()
    h = h[new]
    return [h[a:b] for a, b in zip(at, at[1:])]


def _sorted_parts(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorts each stretch of `count` values where it lies; the edges of the stretches."""
    edge = np.append(0, np.cumsum(count))
    ends = edge.tolist()
    for a, b in zip(ends, ends[1:]):
        values[a:b].sort()
    return edge


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact Jaccard test of two sorted sets."""
    return bool(_alike_pairs([a, b], percent)[0])


def _alike_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The same for sets 0 and 1, sets 2 and 3, ...: what a pair has in common stands twice among its sorted values."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets)).reshape(-1, 2).sum(axis=1)
    ends, out, lo = np.cumsum(sizes), [], 0
    while lo < len(sizes):  # parts of about `VALUES` numbers: the pairs of large sets are not copied all at once
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + VALUES, "right")))
        values, total = np.concatenate(sets[2 * lo : 2 * hi]), sizes[lo:hi]
        edge = _sorted_parts(values, total)
        twice = np.append(0, np.cumsum(values[1:] == values[:-1]))
        both = twice[edge[1:] - 1] - twice[edge[:-1]]
        out.append(100 * both >= percent * (total - both))
        lo = hi
    return np.concatenate(out)


def group_links(group: np.ndarray, own: np.ndarray, texts: list[bytes], percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): linked members. `group` numbers the groups, members of one standing together; own is each one's text."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    start = np.repeat(first, np.diff(np.append(first, len(group))))
    # Most groups are one text: its members are linked at once. Only the other groups' texts get sets.
    mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    plain = np.repeat(~mixed, np.diff(np.append(first, len(group)))) & (start != np.arange(len(group)))
    a, b = [np.flatnonzero(plain)], [start[plain]]
    edge = np.append(first, len(group))
    places = [np.arange(edge[g], edge[g + 1]) for g in np.flatnonzero(mixed)]
    if places:
        needed = np.unique(own[np.concatenate(places)])
        sets = dict(zip(needed.tolist(), _sets([texts[x] for x in needed], k)))
        few = [at for at in places if len(at) <= FEW]
        pairs = np.array([(x, y) for at in few for k, x in enumerate(at.tolist()) for y in at[k + 1 :].tolist()], np.int64).reshape(-1, 2)
        if len(pairs):
            linked = pairs[_alike_pairs([sets[x] for x in own[pairs.ravel()].tolist()], percent)]
            a.append(linked[:, 1])
            b.append(linked[:, 0])
        for at in places:
            if len(at) <= FEW:
                continue
            distinct, lead, which = np.unique(own[at], return_index=True, return_inverse=True)
            pivots = PIVOTS if len(distinct) >= MANY else 1
            root = lead[connect([sets[x] for x in distinct.tolist()], percent, pivots, PROBE)][which]
            apart = np.flatnonzero(root != np.arange(len(at)))
            a.append(at[apart])
            b.append(at[root[apart]])
    return np.concatenate(a), np.concatenate(b)


def line_links(docs: DataFrame, table: DataFrame, copies: DataFrame, percent: int, shingle: int, key: str, text: str) -> DataFrame:
    """(a, b): verified links that connect the near-equal lines with keys. `copies` (node) take no part: a line of the
    same text and with a smaller number has the same keys, and so stands in the same groups."""
    posts = table.filter("line >= 0 and node = first").select(F.explode("keys").alias("k"), F.col("node").alias("doc"))
    posts = posts.repartition("k").sortWithinPartitions("k", "doc")
    led = posts.mapInArrow(_led, "doc long, leader long, keys long").select(F.col("doc").alias("node"), "leader")
    led = written(led.repartition("node").distinct().join(copies, "node", "left_anti"), "line-led")
    size = led.groupBy("leader").agg(F.count("*").alias("g")).filter("g > 1")
    tasks = max(1, led.count() // GROUPS_PER_TASK)
    blocks = F.when(F.col("g") > BLOCK, F.ceil(2 * F.col("g") / BLOCK)).otherwise(1).cast("bigint")
    task = F.when(F.col("g") > BLOCK, F.shiftright(F.xxhash64(F.lit("cells"), "leader"), 1)).otherwise(F.pmod(F.xxhash64("leader"), F.lit(tasks)))
    members = led.join(size.select("leader", blocks.alias("blocks"), task.alias("task")), "leader")

    def verify(part: pa.Table) -> pa.Table:
        leader, cell, node = (part.column(c).to_numpy() for c in ("leader", "cell", "node"))
        order = np.lexsort((node, cell, leader))
        new = (np.diff(leader[order]) != 0) | (np.diff(cell[order]) != 0)
        text = part.column("line").combine_chunks().dictionary_encode()
        x, y = group_links(np.append(0, np.cumsum(new)), text.indices.to_numpy()[order].astype(np.int64), text.dictionary.to_pylist(), percent, shingle)
        tx.give_back()
        return pa.table({"a": node[order[x]], "b": node[order[y]]})

    return _line_groups(docs, members, key, text).groupBy("task").applyInArrow(verify, "a long, b long")


def dedup_lines(
    docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, least: int = LEAST,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_lines, n_removed, removed): for each document its lines with a word, and those that go.

    removed: (line, kept_doc, kept_line), line numbers from 0 at each line feed, in rising order; null where no line
    goes. With `least`, lines of fewer characters are left alone. A null or empty text has no lines. Nothing is
    removed from rows with a null key; rows that repeat a key are one document. The key must be an integer.
    Other columns are ignored; an empty table gives no rows.
    """
    table = written(line_table(docs, least, shingle, bands, rows, key, text), "lines")
    doc = F.shiftright("a", LINE_BITS).alias("doc")
    again = written(table.filter("line = -1 and doc is not null").groupBy("doc").count().filter("count > 1").select("doc"), "line-again")
    twins = written(line_twins(table), "line-twins")
    # A line of a key that comes in one row has one text: as a copy it needs no comparison, and nothing but a smaller line of its text.
    alone = twins.join(again, doc == F.col("doc"), "left_anti").select(F.col("a").alias("node"))
    links = written(line_links(docs, table, alone, percent, shingle, key, text), "line-links")
    copies = table.filter("line >= 0 and node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    several = copies.join(again, doc == F.col("doc"), "left_semi")
    found = written(components(links.unionByName(twins).unionByName(several)), "line-found")
    one = copies.join(again, doc == F.col("doc"), "left_anti").join(found.withColumnRenamed("node", "b"), "b", "left")
    found = found.filter("node <> component").unionByName(one.select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component")))
    number = lambda c: F.col(c).bitwiseAND((1 << LINE_BITS) - 1)
    gone = found.select(
        F.shiftright("node", LINE_BITS).alias("doc"),
        F.struct(number("node").alias("line"), F.shiftright("component", LINE_BITS).alias("kept_doc"), number("component").alias("kept_line")).alias("one"),
    )
    removed = gone.groupBy("doc").agg(F.sort_array(F.collect_list("one")).alias("removed"))
    out = table.filter("line = -1").select("doc", "n_lines").join(removed, "doc", "left")
    return out.select(
        F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_lines",
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("bigint").alias("n_removed"), "removed",
    )


def without_lines(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """`docs` with the removed lines cut out of the text; all columns are kept. `mark` names a column for whether any was."""
    goes = removed.filter("n_removed > 0").select(F.col(key).alias("_key"), F.col("removed.line").alias("_lines")).dropDuplicates(["_key"])

    def cut(bodies: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for body, lines in bodies:
            out = []
            for t, numbers in zip(body, lines):
                if t is not None and numbers is not None:
                    off = set(int(x) for x in numbers)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in off)
                out.append(t)
            yield pd.Series(out, dtype=object)

    kept = F.pandas_udf(cut, "string")
    joined = docs.join(goes, F.col(key) == F.col("_key"), "left")
    out = joined.withColumn(text, kept(F.col(text), F.col("_lines")))
    return (out.withColumn(mark, F.col("_lines").isNotNull()) if mark else out).drop("_key", "_lines")
