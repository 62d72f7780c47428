"""Where windows of a corpus repeat: the part that substring dedup by words and by bytes have in common.

A window is `size` consecutive symbols (words or bytes) of one text. Its anchor is the `gram` symbols with the
smallest hash in it, so equal windows have equal anchors, at the same place inside. Successive windows with one
anchor form a segment (anchor, content, place). Segments are dealt by anchor and sorted, so a stream sees
which anchors occur once - most of them; those windows cannot repeat - and which segments repeat an earlier
one word for word. A task that holds several copies of a segment deals only the first of them by its anchor and
spreads the others, which are known to repeat, so an anchor with a third of all rows does not fill one task.
A group of copies, however large, is thus reduced to its first before texts are moved.
The different segments of an anchor then meet in one shard, whose index (a suffix array, an FM-index) tells
which of their windows are equal. An anchor with more than `crowd` different segments is refined: its windows
become segments of their own, with the whole window as anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import text as tx
from tilewright.llm.store import written

SHARD_BYTES = 2 << 20
CROWD = 50_000
FIELDS = "anchor long, mark long, doc long, at long, n long"
ALONE, HAS_COPIES, COPY = 0, 1, 2
DEALT = f"deal long, {FIELDS}, copies long"
DEALT_NAMES = ["deal", "anchor", "mark", "doc", "at", "n", "copies"]


def _symbols(raw: np.ndarray, starts: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first symbol of each row) of the slice's words or bytes."""
    if not words:
        return tx.byte_codes(raw), starts
    first, end, before = tx.words(raw, starts)
    return (tx.word_codes(raw, first, end) if len(first) else np.zeros(0, np.uint64)), before


def slice_segments(raw: np.ndarray, starts: np.ndarray, words: bool, size: int, gram: int) -> list[np.ndarray]:
    """(row, anchor, mark, at, n) of every segment of the slice."""
    codes, before = _symbols(raw, starts, words)
    if len(codes) < size:
        return [np.zeros(0, np.int64)] * 5
    rolling = tx.Rolling(codes)
    grams = rolling.grams(gram)
    anchor = tx.anchors(grams, size - gram + 1)
    windows = np.maximum(0, np.diff(before) - size + 1)
    row = np.repeat(np.arange(len(windows)), windows)
    window = tx.spread(before[:-1], windows)
    if not len(window):
        return [np.zeros(0, np.int64)] * 5
    own = anchor[window]
    new = np.append(True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(window)))
    begin = window[first]
    mark = rolling(begin, begin + n - 1 + size)
    return [row[first], tx.signed(grams[own[first]]), tx.signed(mark), begin - before[row[first]], n]


def _pre_sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(deal, anchor, mark, doc, at, n, copies): the rows of one slice, copies of each other told apart.

    A row that repeats a place belongs to a row that repeats a key, and is passed over.
    """
    anchor, mark, doc, at, n = columns
    by = np.lexsort((at, doc, mark, anchor))
    anchor, mark, doc, at, n = (c[by] for c in columns)
    same = np.append(False, (anchor[1:] == anchor[:-1]) & (mark[1:] == mark[:-1]))
    again = same & np.append(False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
    anchor, mark, doc, at, n, same = (c[~again] for c in (anchor, mark, doc, at, n, same))
    copies = np.where(same, COPY, np.where(np.append(same[1:], False), HAS_COPIES, ALONE))
    spread_ = tx.signed(tx.mix((doc.astype(np.uint64) << np.uint64(24)) ^ at.astype(np.uint64)))
    return [np.where(same, spread_, anchor), anchor, mark, doc, at, n, copies.astype(np.int64)]


def segments(docs: DataFrame, words: bool, size: int, gram: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, raw, starts in tx.slices(batch.column(1), tx.SLICE_BYTES):
                row, anchor, mark, place, n = slice_segments(raw, starts, words, size, gram)
                if len(row):
                    columns = _pre_sorted([anchor, mark, ids[at + row], place, n])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], DEALT_NAMES)

    return docs.filter("doc is not null").select("doc", "text").mapInArrow(cut, DEALT)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments sorted by all fields: those whose anchor occurs again, with their role.

    0: the only one of its content; 1: the first of several; 2: a repetition of an earlier one. A stream that
    holds two rows back; known copies pass.
    """
    names = ["anchor", "mark", "doc", "at", "n"]
    held = [np.zeros(0, np.int64)] * 6
    told = 0  # how many of the held rows are out already

    def out(rows: list[np.ndarray], role: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*rows, role.astype(np.int32))], [*names, "role"])

    def judge(rows: list[np.ndarray], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        anchor, mark, copies = rows[0], rows[1], rows[5]
        same_anchor = np.append(False, anchor[1:] == anchor[:-1])
        same = same_anchor & np.append(False, mark[1:] == mark[:-1])
        next_anchor, next_same = np.append(same_anchor[1:], False), np.append(same[1:], False)
        role = np.where(same, 2, np.where(next_same | (copies == HAS_COPIES), 1, 0))
        use = np.flatnonzero((same_anchor | next_anchor | (copies == HAS_COPIES))[lo:hi]) + lo
        if len(use):
            yield out([c[use] for c in rows[:5]], role[use])

    for batch in batches:
        new = [c.to_numpy() for c in batch.columns[1:]]
        copy = new[5] == COPY
        if copy.any():
            yield out([c[copy] for c in new[:5]], np.full(int(copy.sum()), 2))
        rows = [np.concatenate([h, c[~copy]]) for h, c in zip(held, new)]
        again = np.append(False, np.logical_and.reduce([c[1:] == c[:-1] for c in rows[:4]])) if len(rows[0]) else np.zeros(0, bool)
        # The earlier of two rows of one place stays; it has copies if either has.
        rows[5] = np.maximum(rows[5], np.append(np.where(again[1:], rows[5][1:], 0), 0)) if len(rows[0]) else rows[5]
        rows = [c[~again] for c in rows]
        count = len(rows[0])
        if count - 1 > told:
            yield from judge(rows, told, count - 1)
        keep = max(0, count - 2)
        told = max(told, count - 1) - keep
        held = [c[keep:] for c in rows]
    if len(held[0]) > told:
        yield from judge(held, told, len(held[0]))


def met(posts: DataFrame) -> DataFrame:
    sort = ["anchor", "mark", "doc", "at"]
    return posts.repartition("deal").sortWithinPartitions(*sort).mapInArrow(_met, FIELDS + ", role int")


def word_spans(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(body, np.uint8)
    first, end, _ = tx.words(raw, np.array([0, len(raw)]))
    return first, end


def _contents(docs: DataFrame, firsts: DataFrame, words: bool, size: int, shards: int) -> DataFrame:
    """(shard, doc, at, n, role, body): the text of each segment. Segments of a document are bounded by its length."""
    wanted = firsts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "n", "role")).alias("parts"))
    texts = docs.join(wanted, "doc").select("doc", "text", "parts")

    names = ["shard", "doc", "at", "n", "role", "body"]

    def batch_of(rows: list[tuple], bodies: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bodies, held = [], [], 0
        for batch in batches:
            docs_, texts_, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            edge, flat = lists.offsets.to_numpy(), lists.values
            anchors, ats, ns, roles = (flat.field(k).to_numpy() for k in range(4))
            shards_ = (tx.mix(anchors.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            for i in range(len(batch)):
                own = slice(edge[i] - lists.values.offset, edge[i + 1] - lists.values.offset)
                shard, at, n, role = shards_[own], ats[own], ns[own], roles[own]
                body = (texts_[i].as_py() or "").encode()
                begin, stop = at, at + n - 1 + size
                if words:
                    first, end = word_spans(body)
                    fits = stop <= len(first)  # not so in another row with the same key
                    shard, at, n, role, stop = (x[fits] for x in (shard, at, n, role, stop))
                    begin, stop = first[at], end[stop - 1]
                rows.append((shard, np.full(len(at), docs_[i]), at, n, role))
                bodies += [body[a:b] for a, b in zip(begin.tolist(), stop.tolist())]
                held += int((stop - begin).sum())
                if held > 4 << 20:
                    yield batch_of(rows, bodies)
                    rows, bodies, held = [], [], 0
        if rows:
            yield batch_of(rows, bodies)

    return texts.mapInArrow(cut, "shard long, doc long, at long, n long, role int, body binary")


def _refined(docs: DataFrame, crowded: DataFrame, words: bool, size: int) -> DataFrame:
    """Every window of the given segments as a segment of its own, anchored by all of its symbols."""
    wanted = crowded.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "role")).alias("parts"))
    texts = docs.join(wanted, "doc").select("doc", "text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                parts = batch.column(2)[i].values
                at, n, _ = (parts.field(k).to_numpy() for k in range(3))
                raw = np.frombuffer((batch.column(1)[i].as_py() or "").encode(), np.uint8)
                codes, _ = _symbols(raw, np.array([0, len(raw)]), words)
                windows = np.unique(tx.spread(at, n))
                windows = windows[windows + size <= len(codes)]
                whole = tx.Rolling(codes)(windows, windows + size)
                doc = np.full(len(windows), batch.column(0)[i].as_py(), np.int64)
                columns = _pre_sorted([tx.signed(whole), tx.signed(tx.mix(whole)), doc, windows, np.ones(len(windows), np.int64)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], DEALT_NAMES)

    return texts.mapInArrow(cut, DEALT)


def repeated_windows(
    docs: DataFrame, words: bool, size: int, gram: int, search: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    keep_first: bool, crowd: int, shard_bytes: int,
) -> DataFrame:
    """(doc, at, n): stretches of windows that go. `docs` has a long `doc` and `text`.

    search(bodies, doc, at, n, role) gets a shard's segments and tells for all their windows, in order, which go.
    With `keep_first` the first of equal windows stays, else none.
    """
    found = written(met(segments(docs, words, size, gram)), "met")
    # A copy of an earlier segment goes with all its windows; so does the first of several unless it stays.
    gone = [found.filter("role = 2").select("doc", "at", "n")]
    firsts = found.filter("role < 2")
    many = firsts.groupBy("anchor").agg(F.count("*").alias("_c")).filter(F.col("_c") > crowd).select("anchor")
    crowded = written(firsts.join(many, "anchor", "left_semi"), "crowded")
    if not crowded.isEmpty():
        alone = written(met(_refined(docs, crowded, words, size)), "windows")
        gone.append(alone.filter("role = 2" if keep_first else "role > 0").select("doc", "at", "n"))
        if not keep_first:  # copies make their first's windows repeat even where no other segment does
            gone.append(crowded.filter("role = 1").select("doc", "at", "n"))
        firsts = firsts.join(many, "anchor", "left_anti")
    volume = firsts.agg(F.sum(F.col("n") - 1 + size)).first()[0] or 0
    shards = max(1, int(volume) * (6 if words else 1) // shard_bytes)

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["doc", "at"])  # rows that repeat a key
        doc, at, n, role = (part[c].to_numpy() for c in ("doc", "at", "n", "role"))
        goes = search(part["body"].tolist(), doc, at, n, role)
        window, segment = tx.spread(at, n), np.repeat(np.arange(len(n)), n)
        edge = np.flatnonzero(goes & ~(np.append(False, goes[:-1]) & np.append(False, segment[1:] == segment[:-1])))
        last = np.flatnonzero(goes & ~(np.append(goes[1:], False) & np.append(segment[1:] == segment[:-1], False)))
        return pd.DataFrame({"doc": doc[segment[edge]], "at": window[edge], "n": last - edge + 1})

    gone.append(_contents(docs, firsts, words, size, shards).groupBy("shard").applyInPandas(shard, "doc long, at long, n long"))
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return written(out, "gone")


def cover(at: np.ndarray, n: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of `length` symbols lie in a window that goes."""
    depth = np.zeros(length + 1, np.int64)
    np.add.at(depth, np.minimum(at, length), 1)
    np.add.at(depth, np.minimum(at + n - 1 + size, length), -1)
    return np.cumsum(depth[:-1]) > 0


def with_stretches(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc, text, at, n): each document with its stretches, as lists bounded by the document's length."""
    lists = gone.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("_s")).select("doc", F.col("_s.at").alias("at"), F.col("_s.n").alias("n"))
    return docs.join(lists, "doc", "left").select("doc", "text", "at", "n")
