"""Exact quantiles of any numbers, however many of them differ.

Selection by range counts: the values between two numbers are counted in BINS ranges, the range that holds the
wanted rank is counted again, and so on until it holds one value or few rows. A pass keeps a counter for each range
and not for each value, partial counts are combined before the shuffle, and only counts of ranges reach the driver.
Ranges are of equal width; after a pass that left most rows in one range, as a far outlier does, the next has ranges
of equal width in the logarithm. A magnitude has 52 bits, and a pass settles 12, so there are never many passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import stored

BINS = 4096
# A range of this many rows or fewer is read whole.
FEW = 4096


@dataclass
class _Search:
    """The value of rank `rank` (from 0) in a column: it is between lo and hi, and `below` values are less than lo."""

    column: int
    rank: int
    below: int
    lo: float
    hi: float
    rows: int
    even: bool = True  # ranges of equal width next
    value: float | None = None


def _magnitude(x):
    """A finite number that never falls where x rises: the logarithm, mirrored for negative numbers."""
    if isinstance(x, Column):
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.lit(1100.0) + F.least(F.log2(F.abs(x)), F.lit(1030.0))))
    return 0.0 if x == 0 else math.copysign(1100.0 + min(math.log2(abs(x)), 1030.0), x)


def _bin(x: Column, lo: float, hi: float, even: bool) -> Column:
    if even and hi - lo < math.inf or _magnitude(lo) == _magnitude(hi):
        at = (x - lo) / (hi - lo)
    else:
        at = (_magnitude(x) - _magnitude(lo)) / (_magnitude(hi) - _magnitude(lo))
    return F.greatest(F.least(F.floor(at * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")


def _narrowed(rows: DataFrame, names: list[str], open_: list[_Search]) -> None:
    """One pass: each search goes on in the range that holds its rank."""
    ranges = sorted({(s.column, s.lo, s.hi, s.even) for s in open_})
    cells = [
        F.when(F.col(names[c]).between(lo, hi), F.struct(F.lit(k).alias("k"), _bin(F.col(names[c]), lo, hi, even).alias("bin"), F.col(names[c]).alias("x")))
        for k, (c, lo, hi, even) in enumerate(ranges)
    ]
    counted = (
        rows.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
        .groupBy("s.k", "s.bin").agg(F.count("*").alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi"))
    )
    found: dict[int, list] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["k"], r["bin"])):  # BINS rows a range
        found.setdefault(r["k"], []).append(r)
    for s in open_:
        for r in found[ranges.index((s.column, s.lo, s.hi, s.even))]:
            if s.below + r["n"] > s.rank:
                s.even = not s.even or r["n"] * 16 < s.rows
                s.lo, s.hi, s.rows = r["lo"], r["hi"], r["n"]
                break
            s.below += r["n"]


def _read(rows: DataFrame, names: list[str], open_: list[_Search]) -> None:
    """The values of small ranges, in order."""
    ranges = sorted({(s.column, s.lo, s.hi) for s in open_})
    cells = [F.when(F.col(names[c]).between(lo, hi), F.struct(F.lit(k).alias("k"), F.col(names[c]).alias("x"))) for k, (c, lo, hi) in enumerate(ranges)]
    counted = rows.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s")).groupBy("s.k", "s.x").agg(F.count("*").alias("n"))
    values = sorted((r["k"], r["x"], r["n"]) for r in counted.collect())  # at most FEW rows a range
    for s in open_:
        at = s.below
        for k, x, n in values:
            if k == ranges.index((s.column, s.lo, s.hi)):
                at += n
                if at > s.rank:
                    s.value = x
                    break


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """The quantile of every column at every share from 0 to 1, linear between neighbours; None without values.

    Nulls and NaN are no values. The columns are written once, and each pass reads them again; passes run here and now.
    """
    if not all(0 <= p <= 1 for p in shares):
        raise ValueError("shares are from 0 to 1")
    names = [f"v{k}" for k in range(len(columns))]
    rows = stored(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(n) for c, n in zip(columns, names)]), "values")
    whole = rows.agg(*[f(n).alias(f"{n}{s}") for n in names for s, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    searches: dict[tuple[int, int], _Search] = {}
    for c, n in enumerate(names):
        for p in shares:
            place = p * (whole[f"{n}n"] - 1)
            for rank in {math.floor(place), math.ceil(place)} if whole[f"{n}n"] else ():
                searches[c, rank] = _Search(c, rank, 0, whole[f"{n}lo"], whole[f"{n}hi"], whole[f"{n}n"])
    while True:
        for s in searches.values():
            if s.lo == s.hi:
                s.value = s.lo
        wide = [s for s in searches.values() if s.value is None and s.rows > FEW]
        if not wide:
            break
        _narrowed(rows, names, wide)
    last = [s for s in searches.values() if s.value is None]
    if last:
        _read(rows, names, last)
    out: dict[str, list[float | None]] = {}
    for c, (column, n) in enumerate(zip(columns, names)):
        out[column] = []
        for p in shares:
            place = p * (whole[f"{n}n"] - 1)
            if not whole[f"{n}n"]:
                out[column].append(None)
                continue
            a, b = searches[c, math.floor(place)].value, searches[c, math.ceil(place)].value
            part = place - math.floor(place)
            out[column].append(a if a == b else a * (1 - part) + b * part)
    return out
