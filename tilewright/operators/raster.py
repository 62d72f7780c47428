"""Painted masks as runs of equal cells, and what is painted where."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geometry as g


def run_rows(cells: DataFrame, marks: list[str], key: str = "tile", x: str = "cell_x", y: str = "cell_y") -> DataFrame:
    """(key, y, from_x, to_x, marks): neighbouring cells of a row with equal marks become one run. A cell occurs once.

    Cells that lie together, as `tiling.rasterise` leaves them, are joined to runs before these meet by row.
    """
    names = [key, y, "from_x", "to_x", *marks]
    pieces = cells.select(F.col(key), F.col(y), F.col(x).alias("from_x"), F.col(x).alias("to_x"), *marks)
    pieces = pieces.mapInArrow(joiner(len(marks)), pieces.schema)
    line = Window.partitionBy(key, y).orderBy("from_x")
    alike = F.lit(True)
    for c in marks:
        alike = alike & F.lag(c).over(line).eqNullSafe(F.col(c))
    new = F.when(alike & (F.lag("to_x").over(line) + 1 == F.col("from_x")), 0).otherwise(1)
    runs = pieces.withColumn("_new", new).withColumn("_run", F.sum("_new").over(line))
    return runs.groupBy(key, y, "_run").agg(F.min("from_x").alias("from_x"), F.max("to_x").alias("to_x"), *[F.first(c).alias(c) for c in marks]).select(names)


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, null among them; of nested values all are told apart."""
    if pa.types.is_nested(column.type):
        return np.arange(len(column))
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def joiner(n_marks: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: cells (key, y, from_x, to_x, marks) to the runs that they make within their batch, if places are whole numbers."""

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        line, x = [_codes(batch.column(k)) for k in (0, 1)], batch.column(2)
        # Without a place a cell is a run of its own.
        known, x = x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((x, ~known, line[1], line[0]))
        same = lambda v: v[order][1:] == v[order][:-1]
        joined = (np.diff(x[order]) == 1) & known[order][1:] & known[order][:-1]
        for v in [*line, *[_codes(batch.column(4 + k)) for k in range(n_marks)]]:
            joined &= same(v)
        first = order[np.append(True, ~joined)]
        last = order[np.append(~joined, True)]
        at = lambda k, rows: batch.column(k).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([at(0, first), at(1, first), at(2, first), at(3, last), *[at(4 + k, first) for k in range(n_marks)]], schema=batch.schema)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield runs(batch) if pa.types.is_integer(batch.column(2).type) else batch

    return join


def marks_at(points: DataFrame, runs: DataFrame, px: Column, py: Column, marks: list[str], key: str = "tile", y: str = "cell_y", cell: int = 1) -> DataFrame:
    """`points` with the marks of the run they lie in, null where nothing is painted.

    Points meet the runs of their own row of cells only, so a crowded mask is spread over its rows.
    """
    placed = points.withColumns({"_px": F.floor(px / cell).cast("bigint"), "_py": F.floor(py / cell).cast("bigint")})
    own = runs.select(F.col(key).alias("_k"), F.col(y).cast("bigint").alias("_y"), "from_x", "to_x", *[F.col(c).alias(f"_m_{c}") for c in marks])
    held = (F.col(key) == F.col("_k")) & (F.col("_py") == F.col("_y")) & F.col("_px").between(F.col("from_x"), F.col("to_x"))
    found = placed.join(own, held, "left")
    return found.select(*points.columns, *[F.col(f"_m_{c}").alias(c) for c in marks])


def marks_at_mean(objects: DataFrame, runs: DataFrame, marks: list[str], key: str = "tile", cell: int = 1) -> DataFrame:
    """Objects with the marks at the mean of their vertices, in whole pixels towards zero."""
    centre = objects.withColumn("_c", g.centroid(F.col("vertices")))
    return marks_at(centre, runs, g.trunc(F.col("_c.x")), g.trunc(F.col("_c.y")), marks, key, cell=cell).drop("_c")


def painter(side: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: rows (tile, object, class_mark, x0, x1, y0, y1 in cells), sorted by tile and object, to painted cells.

    The cells of a tile that goes on in the next batch are painted there first, as boxes of one cell.
    """
    most = max(1 << 20, side * side)

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of `most` cells or so, or one box."""
        x0, x1, y0, y1 = (batch.column(k).to_numpy().astype(np.int64) for k in range(3, 7))
        total = np.cumsum((x1 - x0 + 1) * (y1 - y0 + 1))
        start = 0
        while start < len(total):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end

    def paint(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, int]:
        """(tile, object, class_mark, x0, x1, y0, y1) of every painted cell, and where the last tile begins."""
        x0, x1, y0, y1 = (rows.column(k).to_numpy().astype(np.int64) for k in range(3, 7))
        tile = pa.array(rows.column(0)).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        wide, high = x1 - x0 + 1, y1 - y0 + 1
        n = wide * high
        box = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n)
        x, y = x0[box] + k // high[box], y0[box] + k % high[box]
        place = (tile[box] * side + x) * side + y
        order = np.argsort(place, kind="stable")
        ordered = place[order]
        top = order[np.append(ordered[1:] != ordered[:-1], True)]  # of equal places the last
        x, y = (pa.array(c[top].astype(np.int32)) for c in (x, y))
        given = [rows.column(c).take(pa.array(box[top])) for c in range(3)]
        painted = pa.RecordBatch.from_arrays([*given, x, x, y, y], schema=rows.schema)
        return painted, int(np.searchsorted(tile[box[top]], tile[-1]))

    def cells(painted: pa.RecordBatch) -> pa.RecordBatch:
        tile, object_, mark, x, _, y, _ = painted.columns
        return pa.RecordBatch.from_arrays([tile, x, y, object_, mark], names=["tile", "cell_x", "cell_y", "object", "class_mark"])

    def paint_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for piece in pieces(batch):
                rows = piece if left is None else pa.concat_batches([left, piece.cast(left.schema)])
                painted, last = paint(rows)
                yield cells(painted.slice(0, last))
                left = painted.slice(last)
        if left is not None:
            yield cells(left)

    return paint_all
