"""Boxes and polygons as columns.

A polygon is an array<struct<x,y>> in drawing order, one row per object, so every operation on it is
a projection: no explode, no re-grouping, and an object's vertices never meet another object's task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import let


def trunc(x: Column) -> Column:
    """Towards zero, as a bigint."""
    return x.cast("bigint")


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


# --- boxes -------------------------------------------------------------------------------------


def box_from_numbers(v: Column) -> Column:
    """4 numbers: centre and size. 8 numbers: a rectangle's corners. Anything else: null."""
    x0, y0, x1, y1 = F.get(v, 0), F.get(v, 1), F.get(v, 2), F.get(v, 5)
    return F.when(
        F.size(v) == 4,
        F.struct(F.get(v, 0).alias("xc"), F.get(v, 1).alias("yc"), F.get(v, 2).alias("w"), F.get(v, 3).alias("h")),
    ).when(
        F.size(v) == 8,
        F.struct(
            (x0 + (x1 - x0) / 2).alias("xc"), (y0 + (y1 - y0) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h")
        ),
    )


def normalise_box(x0: Column, y0: Column, w: Column, h: Column, tile_w: int, tile_h: int) -> Column:
    """Corner and size in pixels to centre and size as shares of the tile."""
    return F.struct(
        ((x0 + w / 2) / tile_w).alias("xc"), ((y0 + h / 2) / tile_h).alias("yc"), (w / tile_w).alias("w"), (h / tile_h).alias("h")
    )


def pixel_box(xc: Column, yc: Column, w: Column, h: Column, tile_w: int, tile_h: int) -> Column:
    """Shares of the tile to whole-pixel corners, clipped to the tile."""
    side = lambda c, s, size: (
        trunc(clamp((c - s / 2) * size, F.lit(0.0), F.lit(float(size)))),
        trunc(clamp((c + s / 2) * size, F.lit(0.0), F.lit(float(size)))),
    )
    (x0, x1), (y0, y1) = side(xc, w, tile_w), side(yc, h, tile_h)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def letterbox(old_w: Column, old_h: Column, new_w: int, new_h: int) -> Column:
    """Size and padding of an image scaled by its longer side into a new_w × new_h frame."""
    ratio = F.lit(float(max(new_w, new_h))) / F.greatest(old_w, old_h)
    w, h = trunc(old_w * ratio), trunc(old_h * ratio)
    dw, dh = F.lit(new_w) - w, F.lit(new_h) - h
    left, top = F.floor(dw / 2), F.floor(dh / 2)
    return F.struct(
        ratio.alias("ratio"), w.alias("w"), h.alias("h"),
        left.alias("left"), (dw - left).alias("right"), top.alias("top"), (dh - top).alias("bottom"),
    )


def centred_crop(xc: Column, yc: Column, w: Column, h: Column, size: Column, tile_w: int, tile_h: int) -> Column:
    """Source pixels of a box and where they land, centred, in a square of `size` (a share of the tile)."""

    def axis(c, s, pixels):
        a, b = trunc((c - s / 2) * pixels), trunc((c + s / 2) * pixels)
        start = trunc(size / 2 * pixels - (b - a) / 2)
        return a, b, start, start + (b - a), b - a > trunc(size * pixels)

    ax0, ax1, bx0, bx1, wide = axis(xc, w, tile_w)
    ay0, ay1, by0, by1, tall = axis(yc, h, tile_h)
    return F.struct(
        ax0.alias("src_x0"), ay0.alias("src_y0"), ax1.alias("src_x1"), ay1.alias("src_y1"),
        bx0.alias("dst_x0"), by0.alias("dst_y0"), bx1.alias("dst_x1"), by1.alias("dst_y1"),
        (wide | tall).alias("too_big"),
    )


def holds(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    """Point in box, borders included."""
    return x.between(x0, x1) & y.between(y0, y1)


# --- polygons ----------------------------------------------------------------------------------


def polygon_box(v: Column) -> Column:
    """Corners, centre and size of the bounding box."""

    def box(p: Column) -> Column:
        x0, x1, y0, y1 = p["x0"], p["x1"], p["y0"], p["y1"]
        return F.struct(
            x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
            ((x0 + x1) / 2).alias("xc"), ((y0 + y1) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h"),
        )

    ends = lambda x, y: F.struct(
        F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1")
    )
    # The fields of an array of structs are arrays already: v.x is read, not computed.
    return let(let(v, lambda u: ends(u["x"], u["y"])), box)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def centroid(v: Column) -> Column:
    """Mean of all listed vertices (a repeated closing vertex counts twice); none has no mean."""
    mean = lambda c: F.try_divide(_total(c), F.size(c))
    return let(v, lambda u: F.struct(mean(u["x"]).alias("x"), mean(u["y"]).alias("y")))


def area(v: Column) -> Column:
    """Shoelace area; the last vertex joins the first."""

    def doubled(u: Column) -> Column:
        after = F.concat(F.slice(u, 2, F.size(u)), F.slice(u, 1, 1))
        return _total(F.zip_with(u, after, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")))

    return F.abs(let(v, doubled)) / 2


def clip_shift(v: Column, x0: Column, y0: Column, x1: Column, y1: Column, clip: bool = True) -> Column:
    """Vertices in a rectangle's own coordinates; `clip` first pulls them onto the rectangle."""
    at = (lambda c, lo, hi: clamp(c, lo, hi)) if clip else (lambda c, lo, hi: c)
    return F.transform(v, lambda p: F.struct((at(p["x"], x0, x1) - x0).alias("x"), (at(p["y"], y0, y1) - y0).alias("y")))


def rescale(v: Column, w0: Column, h0: Column, w1: Column, h1: Column) -> Column:
    """Vertices from one pyramid level to another, whole pixels."""
    return F.transform(v, lambda p: F.struct(trunc(p["x"] / w0 * w1).alias("x"), trunc(p["y"] / h0 * h1).alias("y")))


def midpoints(v: Column, times: int = 1) -> Column:
    """Insert the truncated midpoint between consecutive vertices, `times` times over; not closed."""
    for _ in range(times):
        v = let(v, _halve)
    return v


def _halve(v: Column) -> Column:
    middle = lambda p, q, c: trunc((p[c] + q[c]) / 2).alias(c)
    pairs = F.zip_with(
        F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
        F.slice(v, 2, F.size(v)),
        lambda p, q: F.array(F.struct(p["x"], p["y"]), F.struct(middle(p, q, "x"), middle(p, q, "y"))),
    )
    return F.concat(F.flatten(pairs), F.slice(v, -1, 1))


def with_corner(v: Column, tile_w: int, tile_h: int, eps: float = 0.005) -> Column:
    """The first time the outline jumps from one tile border to a perpendicular one, add that corner.

    Outlines are looked at in Arrow batches, all vertices at once.
    """

    def border(share: np.ndarray) -> np.ndarray:
        """0 or 1, or -1 away from borders and without a number."""
        return np.where((share >= 0) & (share <= eps), 0, np.where((share >= 1 - eps) & (share <= 1), 1, -1))

    def insert(outlines: pa.Array) -> pa.Array:
        n = outlines.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        points = outlines.flatten()
        row = np.repeat(np.arange(len(n)), n)
        x, y = (pc.struct_field(points, c).cast("float64", safe=False).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        bx, by = border(x / tile_w), border(y / tile_h)
        first, second = (bx[:-1] >= 0) & (by[1:] >= 0), (by[:-1] >= 0) & (bx[1:] >= 0)
        jumps = np.flatnonzero((first | second) & (row[:-1] == row[1:]))
        rows, place = np.unique(row[jumps], return_index=True)
        p = jumps[place]
        cx, cy = np.where(first[p], bx[p], bx[p + 1]) * tile_w, np.where(first[p], by[p + 1], by[p]) * tile_h
        corners = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (cx, cy)], fields=list(points.type))
        order = np.insert(np.arange(len(points)), p + 1, len(points) + np.arange(len(p)))
        n[rows] += 1
        ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(outlines.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(ends, pa.concat_arrays([points, corners]).take(pa.array(order)))

    whole = "array<struct<x:bigint,y:bigint>>"
    # Annotations are read when the function is made, so they are no strings here.
    insert.__annotations__ = {"outlines": pa.Array, "return": pa.Array}
    return F.arrow_udf(insert, whole)(v.cast(whole))


def vertex_text(v: Column) -> Column:
    """`[{x1, y1}, {x2, y2}, …]`"""
    return v.cast("string")


def polygon_from_numbers(v: Column) -> Column:
    """Flat `x1 y1 x2 y2 …` to vertices."""
    at = F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1)
    return F.transform(at, lambda k: F.struct(F.get(v, k * 2).alias("x"), F.get(v, k * 2 + 1).alias("y")))


# --- windows -----------------------------------------------------------------------------------


def n_windows(dim: Column, tile: int, step: int) -> Column:
    """Whole tiles of size `tile` that start every `step` pixels along `dim`."""
    return F.greatest(F.floor((dim - tile) / step) + 1, F.lit(0)).cast("int")


def touched_windows(lo: Column, hi: Column, dim: Column, tile: int, step: int, closed: bool) -> Column:
    """Indices of the windows that [lo, hi] reaches. `closed` windows include their far border."""
    reach = tile if closed else tile - 1
    first = F.greatest(F.ceil((lo - reach) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(hi / step).cast("int"), n_windows(dim, tile, step) - 1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
