"""Column expressions. Everything here is a narrow projection: no shuffle, no Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once per row, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add a column that is worked out once per row, and keep only rows where `keep` holds for it.

    A plain column would be copied into every later expression and pushed-down filter that uses it.
    """
    values = F.array(value)
    return df.withColumn(name, F.explode(F.filter(values, keep) if keep else values))
