"""Exact row numbers and cut-offs that no single task has to hold.

A window over a whole table, or over a group that holds a third of it, runs in one task. Here a group
is first split into slices whose order is known from the sort key (hex slots of a draw, days, line
numbers); rows are numbered inside their slice and the sizes of the earlier slices are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.draws import slot
from tilewright.session import checkpointed, shuffles_dropped, stored

# A group above this many rows is numbered slice by slice; below it one task sorts it.
HOT_ROWS = 2_000_000


def _groups(by: list[str]) -> list:
    return list(by) or [F.lit(0)]


def split_rank(df: DataFrame, by: list[str], slices: list[Column], order: list, out: str = "rank") -> DataFrame:
    """Row number in each group. `slices` must follow `order`: an earlier slice sorts before a later one.

    A group should have few slices (thousands): their sizes are summed in one task per group.
    """
    names = [f"_s{i}" for i in range(len(slices))]
    cut = df.withColumns(dict(zip(names, slices)))
    sizes = cut.groupBy(*by, *names).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*_groups(by)).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, *names, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, *names).orderBy(*order)
    # The explicit repartition keeps an input that is already hashed on `by` from leaving a group whole.
    numbered = cut.repartition(*by, *names).withColumn("_in", F.row_number().over(inside))
    return (
        numbered.join(before, [*by, *names])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_before", "_in", *names)
    )


def range_rank(df: DataFrame, by: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Row number in each group, whatever the values of `order`: slices are cut where the data have their quantiles.

    Rows are dealt by range of (by, order), so a group lies in successive partitions and no border is fixed beforehand.
    They are written with their place, and the sizes of a group's earlier partitions are added: a row for each
    group and partition. Rows with equal order are numbered in any order and stay in one partition.
    """
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftright("_at", 33))
    sizes = placed.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    running = Window.partitionBy(*_groups(by)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "_p", "_first", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    same = F.col("a._p") == F.col("b._p")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    ranked = placed.alias("a").join(before.alias("b"), same)
    return ranked.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(out))


def hot_keys(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Groups above `rows` rows: at most (table rows / rows) of them, so the result is small enough to broadcast."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(*by)


# Whether a table has hot groups, by plan: queries over one table count its keys once per application.
# An outdated answer costs time, never a wrong result.
_HAS_HOT: dict[tuple, bool] = {}


def hot_cold(df: DataFrame, by: list[str], rows: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame]:
    """(rows of hot groups or None, all other rows).

    A counting job over the key columns runs here and now; where it finds no hot group, as is usual, the
    caller builds its plan for ordinary groups only.
    """
    keys = hot_keys(df, by, rows)
    plan = (df.sparkSession.sparkContext.applicationId, keys.semanticHash())
    if plan not in _HAS_HOT:
        with shuffles_dropped(df.sparkSession):
            _HAS_HOT[plan] = not keys.isEmpty()
    if not _HAS_HOT[plan]:
        return None, df
    hot = F.broadcast(keys)
    return df.join(hot, by, "left_semi"), df.join(hot, by, "left_anti")


def group_rank(
    df: DataFrame, by: list[str], slices: list[Column] | None, order: list, out: str = "rank", rows: int = HOT_ROWS
) -> DataFrame:
    """Row number in each group: one window for ordinary groups, `split_rank` for hot ones, `range_rank` without slices."""
    hot, cold = hot_cold(df, by, rows)
    plain = cold.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    if hot is None:
        return plain
    return plain.unionByName(range_rank(hot, by, order, out) if slices is None else split_rank(hot, by, slices, order, out))


def first_n(df: DataFrame, by: list[str], drawn: str, tie: str, n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group in drawn order, numbered: first per hex slot, then among the survivors.

    The second window sees at most 4096·n rows of a group, however large the group is.
    """
    cut = df.withColumn("_s", slot(F.col(drawn), 3)).repartition(*by, "_s")
    inside = Window.partitionBy(*by, "_s").orderBy(drawn, tie)
    few = cut.withColumn("_in", F.row_number().over(inside)).filter(F.col("_in") <= n).drop("_in", "_s")
    return few.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(drawn, tie))).filter(F.col(out) <= n)


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Row number over the whole table in any order: range sort, then per-partition offsets.

    The sorted rows are checkpointed because the offsets and the rows must see the same partitions.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(before), "_p")  # one row per partition
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
        .drop("_p", "_at", "_before")
    )


def parts_by_draw(
    df: DataFrame,
    drawn: Column,
    tie: str,
    cuts: list[Callable[[Column, Column, Column], Column]],
    by: list[str] = (),
    out: str = "part",
    sizes_as: tuple[str, str] | None = None,
) -> DataFrame:
    """Split each group at given ranks of a random order: part 0 holds the first cut's rows, and so on.

    `cuts` are functions of (rows of the group, rows of the table, rows of the largest group), in rising
    order. `sizes_as` names two columns for the group's and the largest group's size. Nothing is ranked
    but the hex slots that hold a cut: slot sizes locate it, the rows of that slot give its key, and every
    row is then compared with the cut keys, so the table itself is not shuffled: the cut keys are one row per group (a
    class, a flag) and are broadcast. A join on a group would bring half of the table to one task.
    """
    by = list(by)
    keyed = df.select(*by, drawn.alias("_d"), F.col(tie).alias("_t")).withColumn("_s", slot(F.col("_d")))
    sizes = keyed.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    running = Window.partitionBy(*_groups(by)).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    table = Window.partitionBy(F.lit(0))
    totals = sizes.groupBy(*by).agg(F.sum("_c").alias("_n"))  # a row for each group
    totals = totals.withColumns({"_all": F.sum("_n").over(table), "_most": F.max("_n").over(table)})
    summed = sizes.select(*by, "_s", (F.sum("_c").over(running) - F.col("_c")).alias("_lo"), F.sum("_c").over(running).alias("_hi"))
    spans = summed.join(totals, by) if by else summed.crossJoin(totals)  # one row
    given = [F.col("_n"), F.col("_all"), F.col("_most")]
    at = [F.least(F.greatest(c(*given).cast("bigint"), F.lit(0)), F.col("_n")) for c in cuts]
    wanted = (
        spans.select(*by, "_s", "_lo", "_hi", F.posexplode(F.array(*at)).alias("_i", "_cut"))
        .filter((F.col("_cut") > F.col("_lo")) & (F.col("_cut") <= F.col("_hi")))
        .drop("_hi")
    )
    within = Window.partitionBy(*by, "_s", "_i").orderBy("_d", "_t")
    keys = (
        keyed.join(F.broadcast(wanted), [*by, "_s"])  # a row for each group and cut
        .withColumn("_r", F.col("_lo") + F.row_number().over(within))
        .filter(F.col("_r") == F.col("_cut"))
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("_i") == i, F.struct("_d", "_t"))).alias(f"_k{i}") for i in range(len(cuts))])
    )
    here = F.struct(F.col("_d"), F.col(tie).alias("_t"))
    rows = df.withColumn("_d", drawn)
    if by:
        if sizes_as:
            keys = totals.select(*by, F.col("_n").alias(sizes_as[0]), F.col("_most").alias(sizes_as[1])).join(keys, by, "left")
        rows = rows.join(F.broadcast(keys), by, "left")
        limits = [F.col(f"_k{i}") for i in range(len(cuts))]
    else:
        # One subquery for all cuts.
        rows = rows.withColumn("_cuts", keys.select(F.struct(*[f"_k{i}" for i in range(len(cuts))])).scalar())
        limits = [F.col(f"_cuts._k{i}") for i in range(len(cuts))]
    part = sum((F.coalesce(here > k, F.lit(True)).cast("int") for k in limits), F.lit(0))
    return rows.withColumn(out, part).drop("_d", "_cuts", *[f"_k{i}" for i in range(len(cuts)) if by])
