"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

Documents are the leaves' rows of a tree (by default domain - language - source). A token budget goes down the
tree: at each node it is shared among the children by weight; a child that cannot use its share (its subtree
holds too few tokens, counted `max_epochs` times) gets what it can use, and the rest is shared again among its
siblings. Because a node never receives more than its subtree can use, a shortage only reaches the ancestors'
siblings when all siblings are full. Each level is a window over the nodes of one parent, sorted by the
weight level at which they are full.

A leaf spends its budget in epochs: whole ones first, then a prefix of the next epoch, in an order drawn from
(seed, epoch, key). The prefix is found without sorting the leaf: token sums of 65,536 hash slots locate the
slot in which the budget ends, and only that slot's rows are sorted. Every row is then compared with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
OWN = "mix_"  # prefix of all columns made here
LEAVES = 50_000
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide mix_given, the parents' budget, among the children by mix_weight, up to mix_room each."""
    siblings = Window.partitionBy(*(parent or [F.lit(0)]))
    full_at = F.when(F.col("mix_weight") > 0, F.col("mix_room") / F.col("mix_weight")).otherwise(F.lit(float("inf")))
    rising = siblings.orderBy("mix_full_at", name)
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    later = rising.rowsBetween(0, Window.unboundedFollowing)
    to_here = rising.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    left = F.col("mix_given") - F.col("mix_before")
    sums = nodes.withColumn("mix_full_at", full_at).withColumns({"mix_before": total("mix_room", earlier), "mix_after": total("mix_weight", later)})
    marked = sums.withColumn("mix_full", (F.col("mix_weight") > 0) & (F.col("mix_room") * F.col("mix_after") <= F.col("mix_weight") * left))
    open_weight = F.when(F.col("mix_full"), 0.0).otherwise(F.col("mix_weight"))
    rest = marked.withColumns({
        "mix_rest": F.col("mix_given") - total(F.when(F.col("mix_full"), F.col("mix_room")), siblings),
        "mix_open": total(open_weight, siblings),
        "mix_to": total(open_weight, to_here),
    })
    cut = lambda w: F.floor(w * F.col("mix_rest") / F.col("mix_open")).cast("double")
    part = F.when(F.col("mix_full"), F.col("mix_room")).when(F.col("mix_weight") <= 0, 0.0).otherwise(
        F.least(F.col("mix_room"), cut(F.col("mix_to")) - cut(F.col("mix_to") - F.col("mix_weight")))
    )
    return rest.select(*parent, name, part.alias("mix_budget"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: float | None, share: float, max_epochs: int) -> DataFrame:
    """(levels, mix_tokens, mix_budget) from (levels, mix_tokens). All sums are whole numbers kept as doubles."""
    given = None
    for k, name in enumerate(levels):
        parent = levels[:k]
        nodes = leaves.groupBy(*parent, name).agg((F.sum("mix_tokens") * F.lit(float(max_epochs))).alias("mix_room"))
        nodes = nodes.withColumn("mix_weight", weights.get(name, F.lit(1)).cast("double"))
        if given is None:
            # One row per child of the root; the root's budget is known from their sum.
            everything = F.sum("mix_room").over(Window.partitionBy(F.lit(0)))
            asked = F.lit(float(budget)) if budget is not None else F.floor(F.lit(share) * everything / max_epochs).cast("double")
            nodes = nodes.withColumn("mix_given", F.least(asked, everything))
        else:
            nodes = nodes.join(given.withColumnRenamed("mix_budget", "mix_given"), parent)
        given = _share(nodes, parent, name)
    return leaves.join(given, levels)


def _drawn(key: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))


def _with_leaf(rows: DataFrame, leaves: DataFrame, names: list[str], key: str, few: bool) -> DataFrame:
    """`rows` with the columns of their leaf, of which `leaves` has one row each."""
    if few:
        return rows.join(F.broadcast(leaves), names)
    salted = rows.withColumn("mix_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    every = leaves.withColumn("mix_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(every, [*names, "mix_salt"]).drop("mix_salt")


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column] | None = None, budget: float | None = None, share: float = 1.0,
    max_epochs: int = 1, seed: int = 1, tokens: Column | None = None, key: str = "doc_id",
) -> DataFrame:
    """`docs` with mix_<level>, mix_tokens, mix_copies (whole times drawn) and mix_part (tokens of one more, cut copy).

    levels: name -> node of a row, root first; weights: level -> weight of a node, from the mix_<level> columns
    (1 where not given; 0 draws nothing); budget: tokens, or else `share` of the corpus. A null node is a node
    of its own, named ''. Tokens are words unless given. A text without tokens (null, empty) is never drawn.
    Rows that repeat a key are drawn together; if the cut falls on them, each is cut in proportion. All input
    columns are kept (names beginning with mix_ are reserved); an empty table gives no rows.

    The leaves' table is broadcast where it has been counted to have at most `LEAVES` rows. A larger one is joined
    with every leaf split into `SALTS` parts, so that a leaf with a third of all rows is not one task's.
    """
    names = [OWN + n for n in levels]
    weights = {OWN + n: w for n, w in (weights or {}).items()}
    tokens = word_count(F.col("text")) if tokens is None else tokens
    node = {OWN + n: F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    rows = docs.withColumns({**node, "mix_tokens": tokens})
    counted = written(rows.select(F.col(key).alias("mix_key"), *names, "mix_tokens"), "mix")
    leaves = counted.groupBy(*names).agg(F.sum("mix_tokens").cast("double").alias("mix_tokens"))
    budgets = leaf_budgets(leaves, names, weights, budget, share, max_epochs)
    whole = F.when(F.col("mix_tokens") > 0, F.floor(F.col("mix_budget") / F.col("mix_tokens"))).otherwise(0).cast("bigint")
    spent = budgets.withColumn("mix_epochs", whole)
    spent = spent.withColumn("mix_left", F.col("mix_budget") - F.col("mix_epochs") * F.col("mix_tokens"))
    spent = written(spent.select(*names, "mix_epochs", "mix_left"), "mix-leaves")

    few = spent.count() <= LEAVES
    drawn = _drawn(F.col("mix_key"), F.col("mix_epochs"), seed)
    placed = _with_leaf(counted, spent, names, "mix_key", few).filter((F.col("mix_left") > 0) & (F.col("mix_tokens") > 0)).withColumn("mix_draw", drawn)
    placed = placed.withColumn("mix_slot", F.substring("mix_draw", 1, 4))
    slots = placed.groupBy(*names, "mix_slot").agg(F.sum("mix_tokens").alias("mix_n"), F.max("mix_left").alias("mix_left"))
    ends = F.sum("mix_n").over(Window.partitionBy(*names).orderBy("mix_slot"))
    at = slots.withColumn("mix_end", ends).filter((F.col("mix_end") >= F.col("mix_left")) & (F.col("mix_end") - F.col("mix_n") < F.col("mix_left")))
    last = at.select(*names, "mix_slot", (F.col("mix_end") - F.col("mix_n")).alias("mix_from"))
    # At most one slot a leaf.
    units = placed.join(F.broadcast(last) if few else last, [*names, "mix_slot"]).groupBy(*names, "mix_draw", "mix_from", "mix_left").agg(F.sum("mix_tokens").alias("mix_unit"))
    stop = F.col("mix_from") + F.sum("mix_unit").over(Window.partitionBy(*names).orderBy("mix_draw"))
    cuts = units.withColumn("mix_stop", stop).filter((F.col("mix_stop") >= F.col("mix_left")) & (F.col("mix_stop") - F.col("mix_unit") < F.col("mix_left")))
    cuts = cuts.select(*names, F.col("mix_draw").alias("mix_cut"), (F.col("mix_left") - F.col("mix_stop") + F.col("mix_unit")).alias("mix_taken"), "mix_unit")
    every = spent.select(*names, "mix_epochs").join(cuts, names, "left")

    draw = _drawn(F.col(key), F.col("mix_epochs"), seed)
    inside, cut = draw < F.col("mix_cut"), draw == F.col("mix_cut")
    copies = F.col("mix_epochs") + F.when(inside, 1).otherwise(0)
    part = F.when(cut, F.floor(F.col("mix_taken") * F.col("mix_tokens") / F.col("mix_unit"))).otherwise(0).cast("bigint")
    # A cut that takes all of a document is one more whole copy.
    out = _with_leaf(rows, every, names, key, few).withColumns({"mix_copies": copies, "mix_part": part})
    gone, filled = F.col("mix_tokens") == 0, F.col("mix_part") == F.col("mix_tokens")
    return out.withColumns({
        "mix_copies": F.when(gone, 0).when(filled, F.col("mix_copies") + 1).otherwise(F.col("mix_copies")).cast("bigint"),
        "mix_part": F.when(gone | filled, 0).otherwise(F.col("mix_part")).cast("bigint"),
    }).drop("mix_epochs", "mix_cut", "mix_taken", "mix_unit")


def drawn_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows to train on: each document as often as it was drawn, a cut copy counting as a whole one."""
    times = F.col("mix_copies") + F.when(F.col("mix_part") > 0, 1).otherwise(0)
    return mixed.filter(times > 0).withColumn("mix_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select(*columns)
