"""Repair of conversations: faults are counted, and turns kept, re-roled, deleted or inserted at least cost.

Rows are dealt by conversation and sorted, and a stream repairs one conversation after another (`edits`). A
conversation above `most_rows` rows or `most_bytes` bytes of text is cut instead into segments of `segment` rows,
dealt by range, so that no task has to hold it. What a segment does is a small table: for each cost vector behind it
the vector before it, and for each state before it the state behind it. Chaining these tables, a row a segment, gives
every segment its border, after which segments are repaired alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import edits
from tilewright.llm.store import written

MOST_ROWS = 1 << 16
MOST_BYTES = 64 << 20
SEGMENT = 1 << 12

COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost", "turn_least", "turn_most", "turns_distinct"]
SPACES = " \t\n\x0b\x0c\r"
TURNS = pa.struct([("role", pa.string()), ("text", pa.string())])


def _kind(role: Column, text: Column) -> Column:
    """4 * class of the role's initial (s, u, a, other) + 2 if the text is blank + 1 if its last solid character ends no sentence."""
    initial = F.substring(role, 1, 1)
    role_class = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = F.rtrim(text, F.lit(SPACES))
    return (4 * role_class + 2 * (bare == "").cast("int") + (~F.substring(bare, -1, 1).isin(".", "!", "?")).cast("int")).cast("int")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each entry differs from the one before; nulls are equal."""
    code = column.dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.append(True, code[1:] != code[:-1])[: len(code)]


def _turn_counts(turn: pa.Array, starts: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(least, greatest, number of different) of each group's turns, which are sorted, nulls first."""
    null = turn.is_null().to_numpy(zero_copy_only=False)
    value = turn.fill_null(0).to_numpy()
    new = ~null
    new[1:] &= (value[1:] != value[:-1]) | null[:-1]
    new[starts[:-1]] = ~null[starts[:-1]]
    total = np.append(0, np.cumsum(new))
    count = total[starts[1:]] - total[starts[:-1]]
    nulls = np.append(0, np.cumsum(null))
    first = np.minimum(starts[:-1] + nulls[starts[1:]] - nulls[starts[:-1]], starts[1:] - 1)
    return pa.array(value[first], mask=count == 0), pa.array(value[starts[1:] - 1], mask=count == 0), count


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[starts[1:]] - total[starts[:-1]]


def _illegal(role_class: np.ndarray) -> np.ndarray:
    """Whether a row's role may not follow that of the row before: legal are s u, u a and a u."""
    pair = 4 * role_class[:-1] + role_class[1:]
    return np.append(False, ~np.isin(pair, [1, 6, 9]))[: len(role_class)]


def _result(audits: list[str], starts: list[list[int]], kind: np.ndarray, role: pa.Array, text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(cost, turns) of each group, given (first row, state before it) of each."""
    own_class, own_role = (kind >> 2).tolist(), role.to_pylist()
    cost, take, roles, length = [], [], [], [0]
    for audit, (at, state) in zip(audits, starts):
        turns = edits.replay(audit, own_class[at : at + len(audit)], state)
        rows = [at + r if r >= 0 else None for r, _ in turns]
        take += rows
        roles += [new if new is not None else own_role[r] for r, (_, new) in zip(rows, turns)]
        stay = np.array([r for r in rows if r is not None], np.int64)
        cost.append(3 * audit.count(edits.DELETE) + 2 * (audit.count(edits.INSERT) + audit.count(edits.REROLE)) + int((kind[stay] & 1).sum()))
        length.append(len(take))
    texts = text.take(pa.array(take, pa.int64())).fill_null("")
    turns = pa.StructArray.from_arrays([pa.array(roles, pa.string()), texts], fields=list(TURNS))
    return np.array(cost, np.int64), pa.ListArray.from_arrays(pa.array(length, pa.int32()), turns)


def _whole(rows: pa.Table) -> list[pa.Array]:
    """The parts of complete conversations, sorted."""
    conv, turn, role, text, kind = (rows.column(c).combine_chunks() for c in ("conv", "turn", "role", "text", "kind"))
    kind = kind.to_numpy().astype(np.int64)
    new = _changes(conv)
    starts = np.append(np.flatnonzero(new), len(conv))
    group = np.cumsum(new) - 1
    role_code, text_code = (c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (role, text))
    order = np.lexsort((np.arange(len(conv)), text_code, role_code, group))
    again = np.zeros(len(conv), bool)
    again[order[1:]] = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in (group, role_code, text_code)])
    blank = (kind & 2) > 0
    repeats = again & ~blank
    cut = (kind & 1 > 0) & ~blank & ~repeats
    t = edits.tables()
    codes, first = t.blocks(edits.symbols(kind >> 2, blank | repeats, kind & 1), starts)
    codes = codes.tolist()
    audits = [t.audit(codes[a:b])[0] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    cost, turns = _result(audits, [(a, edits.EMPTY) for a in starts[:-1].tolist()], kind, role, text)
    illegal = _illegal(kind >> 2) & ~new
    n = len(audits)
    return [
        conv.take(pa.array(starts[:-1])), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool)),
        *[pa.array(_sums(f, starts)) for f in (blank, repeats, cut, illegal)], pa.array(cost), *map(pa.array, _turn_counts(turn, starts)),
        pa.array(audits, pa.string()), turns,
    ]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; the last one of a batch waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        last = int(np.flatnonzero(_changes(rows.column("conv").combine_chunks()))[-1])
        if last:
            yield pa.RecordBatch.from_arrays(_whole(rows.slice(0, last)), PART_NAMES)
        held = rows.slice(last)
    if held is not None and len(held):
        yield pa.RecordBatch.from_arrays(_whole(held), PART_NAMES)


PART_NAMES = ["conv", "part", "last", *COUNTS, "audit", "turns"]


def _schema(kind: str) -> str:
    return f"conv {kind}, part long, last boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, turns array<struct<role: string, text: string>>"


def _segments(hot: DataFrame, kind: str, segment: int) -> DataFrame:
    """The parts of conversations that no task holds whole."""
    bits = segment.bit_length() - 1
    order = ["conv", "turn", "role", "text"]
    # The row number must be that of the sorted rows, so it is written with them.
    placed = written(hot.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("seg", F.shiftright("at", bits))
    firsts = placed.groupBy("conv", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    narrow = placed.select("conv", "seg", "at", "turn", "kind").join(firsts, "at", "left").fillna(True, ["again"])

    def tabled(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        kinds = rows.column("kind").to_numpy().astype(np.int64)
        blank, again = (kinds & 2) > 0, rows.column("again").to_numpy()
        repeats = again & ~blank
        symbol = edits.symbols(kinds >> 2, blank | repeats, kinds & 1)
        t = edits.tables()
        codes, _ = t.blocks(symbol, np.array([0, len(symbol)]))
        codes = codes.tolist()
        before, behind_state = [], []
        for v in range(len(t.vectors)):
            behind, vector, _ = t.back(codes, v)
            before.append(vector)
            behind_state += [t.forth(codes, behind, q)[1] for q in range(4)]
        whole = np.array([0, len(symbol)])
        least, most, distinct = _turn_counts(rows.column("turn").combine_chunks(), whole)
        cut = (kinds & 1 > 0) & ~blank & ~repeats
        return pa.table({
            "conv": rows.column("conv").slice(0, 1), "seg": rows.column("seg").slice(0, 1), "symbols": [symbol.astype(np.uint8).tobytes()],
            "before": [bytes(before)], "behind": [bytes(behind_state)], "first_class": [int(kinds[0] >> 2)], "last_class": [int(kinds[-1] >> 2)],
            "blank": [int(blank.sum())], "duplicate": [int(repeats.sum())], "truncated": [int(cut.sum())], "illegal": [int(_illegal(kinds >> 2).sum())],
            "turn_least": least, "turn_most": most, "turns_distinct": distinct,
        })

    tables_of = (
        f"conv {kind}, seg long, symbols binary, before binary, behind binary, first_class long, last_class long, blank long, duplicate long, "
        "truncated long, illegal long, turn_least long, turn_most long, turns_distinct long"
    )
    table = written(narrow.groupBy("conv", "seg").applyInArrow(tabled, tables_of), "segments")

    def chained(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seg").combine_chunks()
        column = {c: rows.column(c).to_pylist() for c in rows.column_names}
        n = len(rows)
        border, vector = [0] * n, 0
        for k in reversed(range(n)):
            border[k] = vector
            vector = column["before"][k][vector]
        start, state, illegal, distinct = [], edits.EMPTY, [], []
        for k in range(n):
            start.append(state)
            state = column["behind"][k][4 * border[k] + state]
            pair = np.array([column["last_class"][k - 1], column["first_class"][k]])
            illegal.append(column["illegal"][k] + int(k > 0 and _illegal(pair)[1]))
            same = k > 0 and column["turn_least"][k] is not None and column["turn_least"][k] == column["turn_most"][k - 1]
            distinct.append(column["turns_distinct"][k] - int(same))
        return pa.table({
            "conv": rows.column("conv"), "seg": rows.column("seg"), "part": list(range(n)), "last": [k == n - 1 for k in range(n)],
            "border": border, "start": start, "illegal": illegal, "turns_distinct": distinct,
        })

    chain_of = f"conv {kind}, seg long, part long, last boolean, border long, start long, illegal long, turns_distinct long"
    chain = table.drop("symbols", "blank", "duplicate", "truncated").groupBy("conv").applyInArrow(chained, chain_of)
    left, right = table.drop("illegal", "turns_distinct", "before", "behind").alias("l"), chain.alias("r")
    known = left.join(right, F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.seg") == F.col("r.seg"))).select("l.*", *[f"r.{c}" for c in chain.columns[2:]])

    def repaired(rows: pa.Table, info: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        one = {c: info.column(c)[0].as_py() for c in info.column_names}
        t = edits.tables()
        symbol = np.frombuffer(one["symbols"], np.uint8).astype(np.int64)
        codes = t.blocks(symbol, np.array([0, len(symbol)]))[0].tolist()
        audit, state = t.forth(codes, t.back(codes, one["border"])[0], one["start"])
        audit += edits.END[state] if one["last"] else ""
        kinds = rows.column("kind").to_numpy().astype(np.int64)
        cost, turns = _result([audit], [(0, one["start"])], kinds, rows.column("role").combine_chunks(), rows.column("text").combine_chunks())
        one["cost"] = int(cost[0])
        counts = [pa.array([one[c]], pa.int64()) for c in COUNTS]
        return pa.Table.from_arrays([rows.column("conv").slice(0, 1), pa.array([one["part"]]), pa.array([one["last"]]), *counts, pa.array([audit]), turns], PART_NAMES)

    texts = placed.select("conv", "seg", "at", "role", "text", "kind")
    return texts.groupBy("conv", "seg").cogroup(known.groupBy("conv", "seg")).applyInArrow(repaired, _schema(kind))


def repair_parts(
    rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, segment: int = SEGMENT,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> tuple[DataFrame, DataFrame | None]:
    """`repair` as two tables: conversations that have one part, and the parts of larger ones (None if there are none)."""
    own = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )
    kind = own.schema["conv"].dataType.simpleString()
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    large = written(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select("conv"), "large")
    own = own.withColumn("kind", _kind(F.col("role"), F.col("text")))
    small, hot = own, None
    if not large.isEmpty():
        same = own["conv"].eqNullSafe(large["conv"])
        small, hot = own.join(large, same, "left_anti"), _segments(own.join(large, same, "left_semi"), kind, segment)
    order = ["conv", "turn", "role", "text"]
    return small.repartition("conv").sortWithinPartitions(*order).mapInArrow(_streamed, _schema(kind)), hot


def repair(rows: DataFrame, **options) -> DataFrame:
    """(conv, part, last, blank, duplicate, truncated, illegal, cost, turn_least, turn_most, turns_distinct, audit, turns).

    One row a conversation, part 0; larger ones (see the module) have several parts, in order, whose counts and costs
    add up and whose audits and turns follow one another. Rows of a conversation are taken by turn, nulls first, and
    rows of one turn by role and text, so that equal rows are adjacent. The first fault of a row counts: blank
    (nothing but spaces), duplicate (role and text of an earlier row), truncated (the last character that is no
    space is not one of . ! ?). illegal: rows whose role's initial may not follow that of the row before.

    audit: the edits K(eep), R(erole to user or assistant), D(elete), I(nsert an empty user or assistant turn) that
    make the initials of the roles (s?(ua)+)? at least cost: 0, 2, 3, 2, and 1 for each truncated row that stays; blank
    rows and duplicates must go. Of equally cheap audits it is the least text. turns: the repaired (role, text).

    A null role or text reads as one space; a null turn counts for no turn; rows with a null conversation are one
    conversation; other columns are ignored; no rows give no rows. Texts are shuffled once, those of large
    conversations twice more.
    """
    small, hot = repair_parts(rows, **options)
    return small if hot is None else small.unionByName(hot)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation and part, hashed one after another."""
    names = ["conv", *COUNTS, "audit", "sha256"]
    hashed, started, said, counts = hashlib.sha256(), False, [], []
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k].as_py() for c in ("conv", "last", *COUNTS, "audit", "body", "some")}
            if row["some"]:
                hashed.update((("\n" if started else "") + row["body"]).encode())
                started = True
            said.append(row["audit"])
            counts.append([row[c] for c in COUNTS])
            if row["last"]:
                columns = [[v for v in c if v is not None] for c in zip(*counts)]
                sums = {c: sum(v) for c, v in zip(COUNTS, columns)}
                sums["turn_least"], sums["turn_most"] = (f(columns[COUNTS.index(c)], default=None) for f, c in ((min, "turn_least"), (max, "turn_most")))
                one = [pa.array([row["conv"]], batch.schema.field("conv").type), *[pa.array([sums[c]], pa.int64()) for c in COUNTS]]
                yield pa.RecordBatch.from_arrays([*one, pa.array(["".join(said)]), pa.array([hashed.hexdigest()])], names)
                hashed, started, said, counts = hashlib.sha256(), False, [], []


def digests(small: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(conv, the counts, audit, sha256), one row a conversation: sha256 of its repaired `role:text`, joined by line feeds.

    A hash and an audit of a whole conversation have to be made in one place; that of a large one reads its sorted
    parts as a stream and keeps nothing but the audit.
    """
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = small.select("conv", *COUNTS, "audit", F.sha2(body.cast("binary"), 256).alias("sha256"))
    if hot is None:
        return out
    parts = hot.select("conv", "part", "last", *COUNTS, "audit", body.alias("body"), (F.size("turns") > 0).alias("some"))
    schema = f"conv {out.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, sha256 string"
    return out.unionByName(parts.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_digest, schema))
