"""Benchmark decontamination: texts are streamed through generalised suffix automata of the test items.

Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. Items are gathered into
automata of at most `shard_words` words each (`automaton`); for a few hundred items that is one. An automaton has
at most two states and three steps a word, which bounds what is broadcast. Texts are never shuffled: each passes
the automata where it is read, `per_pass` of them in one pass, and later passes add to what earlier ones found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import text as tx
from tilewright.llm.automaton import Automaton, build
from tilewright.llm.store import written

SIZE = 10
SHARD_WORDS = 1 << 16
PER_PASS = 8

# What a byte counts as: itself in a word, A-Z in lower case, and a space outside of words.
_AS = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _AS[_lo:_hi] = np.arange(_lo, _hi)
_AS[0x41:0x5B] = np.arange(0x61, 0x7B)

FOUND = "n_words long, begin array<long>, n array<long>, items array<string>, longest long"


def slice_words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code) of each normalised word of the slice, and for each row the number of words before it."""
    plain = _AS[raw]
    first, end, before = tx.words(plain, starts)
    return first, end, tx.word_codes(plain, first, end) if len(first) else np.zeros(0, np.uint64), before


def automata(items: DataFrame, size: int = SIZE, shard_words: int = SHARD_WORDS, key: str = "item_id", text: str = "text") -> DataFrame:
    """(automaton) of all items, each of at most `shard_words` words. A longer item is cut into parts that share size - 1 words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([build(parts, names, size)], pa.binary())], ["automaton"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, raw, starts in tx.slices(batch.column(1)):
                _, _, code, before = slice_words(raw, starts)
                for k in range(len(starts) - 1):
                    whole = code[before[k] : before[k + 1]]
                    for lo in range(0, max(1, len(whole) - size + 1), shard_words - size + 1):
                        part = whole[lo : lo + shard_words]
                        if held and held + len(part) > shard_words:
                            yield out()
                            names, parts, held = [], [], 0
                        if len(part):
                            names.append(ids[at + k])
                            parts.append(part)
                            held += len(part)
        if parts:
            yield out()

    own = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    volume = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, int(volume) // (8 * shard_words))
    return written(own.coalesce(tasks).mapInArrow(gather, "automaton binary"), "automata")


def _lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """A list column from values sorted by row."""
    return tx.lists(values, np.bincount(row, minlength=rows), kind)


def _slice_found(machines: list[Automaton], raw: np.ndarray, starts: np.ndarray, earlier: pa.RecordBatch, kept: bool) -> list[pa.Array]:
    """The FOUND columns of a slice's rows, with what earlier passes found; and the kept texts, if wanted."""
    first, end, code, before = slice_words(raw, starts)
    row, rows = tx.row_of(before), len(starts) - 1
    edges = np.zeros(len(code) + 1, np.int64)
    old_begin, old_n, old_items = (earlier.column(c) for c in ("begin", "n", "items"))
    old_row = np.repeat(np.arange(rows), pc.list_value_length(old_begin).to_numpy(zero_copy_only=False))
    begin, n = before[old_row] + old_begin.flatten().to_numpy(), old_n.flatten().to_numpy()
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + n, -1)
    longest = earlier.column("longest").to_numpy().copy()
    item_rows = [np.repeat(np.arange(rows), pc.list_value_length(old_items).to_numpy(zero_copy_only=False))]
    item_names = [np.array(old_items.flatten().to_pylist(), object)]
    for machine in machines:
        stop, words, pattern, reach = machine.matches(code, row)
        if not len(stop):
            continue
        at = row[stop - 1]
        np.add.at(edges, stop - words, 1)
        np.add.at(edges, stop, -1)
        np.maximum.at(longest, at, reach)
        at, item = machine.items_of(at, pattern)
        item_rows.append(at)
        item_names.append(machine.names[item])
    hit = np.cumsum(edges[:-1]) > 0
    new_row = np.append(True, row[1:] != row[:-1])[: len(row)]
    opens = np.flatnonzero(hit & (new_row | ~np.append(False, hit[:-1])[: len(hit)]))
    closes = np.flatnonzero(hit & (np.append(new_row[1:], True)[: len(hit)] | ~np.append(hit[1:], False)[: len(hit)]))
    span_row = row[opens]
    who, name = np.concatenate(item_rows), np.concatenate(item_names)
    pairs = sorted(set(zip(who.tolist(), name.tolist())))
    who, name = np.array([r for r, _ in pairs], np.int64), [i for _, i in pairs]
    out = [
        pa.array(np.diff(before)), _lists(span_row, opens - before[span_row], rows, pa.int64()), _lists(span_row, closes - opens + 1, rows, pa.int64()),
        _lists(who, name, rows, pa.string()), pa.array(longest),
    ]
    if kept:
        off = np.zeros(len(raw) + 1, np.int8)
        off[first[opens]] += 1
        np.add.at(off, end[closes], -1)
        stays = np.cumsum(off[:-1], dtype=np.int8) == 0
        total = np.append(0, np.cumsum(stays))
        offsets = pa.py_buffer(total[starts].astype(np.int64))
        out.append(pa.Array.from_buffers(pa.large_string(), rows, [None, offsets, pa.py_buffer(raw[stays])]).cast(pa.string()))
    return out


def contamination(
    docs: DataFrame, items: DataFrame, size: int = SIZE, max_share: float = 0.2, texts: bool = True, shard_words: int = SHARD_WORDS, per_pass: int = PER_PASS,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, n_words, n_hit, spans, items, longest, over_limit[, clean]) of every row of `docs`.

    A word is hit if it lies in an occurrence of `size` successive words of an item, or of a whole item of fewer.
    spans: (start, n), the maximal stretches of hit words; longest: words of the longest passage shared with an item,
    0 without a hit; items: the sorted ids, as text, of items with an occurrence; over_limit: the hit words are more
    than `max_share` of all, so that the document should go; clean (with `texts`): the text without its spans, from
    the first byte of the first to the last byte of the last word of each.

    A null or empty text has no words, is hit by nothing and is clean as an empty one; repeated rows are judged alike;
    a null key is kept. Items of one id are one item; a null id reads as an empty one; items without words are passed
    over; without items nothing is hit. Other columns are ignored; no documents give no rows. Words are compared by
    64-bit hashes. Documents are not shuffled.
    """
    spark = docs.sparkSession
    stored = [spark.sparkContext.broadcast(bytes(r[0])) for r in automata(items, size, shard_words, item_key, item_text).toLocalIterator()]
    groups = [stored[k : k + per_pass] for k in range(0, max(1, len(stored)), per_pass)]
    kind = docs.schema[key].dataType.simpleString()
    empty = [F.lit(0).cast("long").alias("n_words"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("begin", "long"), ("n", "long"), ("items", "string"))]]
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *empty, F.lit(0).cast("long").alias("longest"))
    for k, group in enumerate(groups):
        last = k == len(groups) - 1
        names = ["key", *[f.split()[0] for f in FOUND.split(", ")], *(["text"] if texts or not last else [])]

        def scan(batches: Iterator[pa.RecordBatch], group=group, last=last, names=names) -> Iterator[pa.RecordBatch]:
            machines = [Automaton(b.value) for b in group]
            for batch in batches:
                for at, raw, starts in tx.slices(batch.column("text")):
                    rows = batch.slice(at, len(starts) - 1)
                    columns = [rows.column("key"), *_slice_found(machines, raw, starts, rows, texts and last)]
                    if not last:
                        columns.append(rows.column("text"))
                    yield pa.RecordBatch.from_arrays(columns, names)

        found = found.mapInArrow(scan, f"key {kind}, {FOUND}" + (", text string" if len(names) > 6 else ""))
    hit = F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
    spans = F.transform(F.arrays_zip("begin", "n"), lambda s: F.struct(s["begin"].alias("start"), s["n"].alias("n")))
    out = found.select(F.col("key").alias(key), "n_words", hit.alias("n_hit"), spans.alias("spans"), "items", "longest", *([F.col("text").alias("clean")] if texts else []))
    return out.withColumn("over_limit", F.col("n_hit") > F.col("n_words") * max_share)
