"""Reproducible draws: a row's place in a random order is the md5 of its key and a seed.

The order depends on the data alone, so a recomputed partition draws the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 10


def draw(*keys: str | Column, seed: int | str = SEED) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))


def slot(drawn: Column, digits: int = 4) -> Column:
    """First hex digits of a draw: an even split of the random order into 16**digits slots."""
    return F.substring(drawn, 1, digits)


def coin(*keys: str | Column, seed: int | str = SEED) -> Column:
    """0 or 1 by the parity of the first md5 character's code."""
    return F.ascii(F.substring(draw(*keys, seed=seed), 1, 1)) % 2
