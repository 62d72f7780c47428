"""Class shares per slide or sample, and the histological class they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_crosstab(objects: DataFrame, by: list[str], ids: dict[str, int]) -> DataFrame:
    """A row per group, a count per class; classes left out of `ids` (false positives) are not counted.

    One partial aggregation: each task sends one row per group, however large the group is.
    """
    known = objects.filter(F.col("class").isin(list(ids.values())))
    return known.groupBy(*by).agg(*[F.count_if(F.col("class") == i).alias(c) for c, i in ids.items()])


def class_shares(counts: DataFrame, classes: list[str]) -> DataFrame:
    """Total per group and each class's share of it, to 4 digits."""
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    shares = {f"{c} share": F.bround(F.col(c) / F.col("total"), 4) for c in classes}
    return counts.withColumn("total", total).withColumns(shares)


def berden_class(shares: dict[str, Column], mixed_rule: bool = False) -> Column:
    """Focal, Crescentic or Sclerotic by the class above one half.

    Without one, all shares are summed, which makes the slide Sclerotic; `mixed_rule` sums the sclerotic
    shares only, so that slides without a majority can be Mixed.
    """
    focal, crescentic = shares["Glomerulus"], shares["Cellular Crescent"]
    sclerotic = [s for c, s in shares.items() if c not in ("Glomerulus", "Cellular Crescent")]
    out = F.when(focal > 0.5, "Focal").when(crescentic > 0.5, "Crescentic")
    for s in sclerotic:
        out = out.when(s > 0.5, "Sclerotic")
    summed = sclerotic if mixed_rule else list(shares.values())
    return out.when(sum(summed[1:], summed[0]) > 0.5, "Sclerotic").otherwise("Mixed")


def berden_scores(objects: DataFrame, by: list[str], ids: dict[str, int], mixed_rule: bool = False) -> DataFrame:
    shares = class_shares(class_crosstab(objects, by, ids), list(ids))
    return shares.withColumn("berden", berden_class({c: F.col(f"{c} share") for c in ids}, mixed_rule))
