"""Bags of instances for multiple-instance learning.

An instance has `instance`, `slide`, `class`. Random order inside a slide comes from md5 draws; slides
of any size are ranked by `group_rank`, which splits the large ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.draws import SEED, draw, slot
from tilewright.operators.ranks import HOT_ROWS, first_n, group_rank, split_rank


def slide_labels(objects: DataFrame, healthy: int = 0, unhealthy: int = 1, levels: int = 4) -> DataFrame:
    """(slide, label): share of unhealthy objects in `levels` steps; slides without objects have none."""
    n = objects.groupBy("slide").agg(
        F.count_if(F.col("class") == healthy).alias("h"), F.count_if(F.col("class") == unhealthy).alias("u")
    )
    step = F.floor(F.col("u") / (F.col("h") + F.col("u")) * levels)
    return n.filter("h + u > 0").select("slide", F.least(step, F.lit(levels - 1)).cast("int").alias("label"))


def labelled_only(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops of slides that have a label."""
    return crops.join(labels.select("slide"), "slide", "left_semi")


def _slide_rank(instances: DataFrame, seed, hot_rows: int, out: str = "rank", by: list[str] = ("slide",)) -> DataFrame:
    drawn = instances.withColumn("_d", draw("instance", seed=seed))
    ranked = group_rank(drawn, list(by), [slot(F.col("_d"))], ["_d", "instance"], out, hot_rows)
    return ranked.drop("_d")


def _slide_sizes(instances: DataFrame, by: list[str] = ("slide",)) -> DataFrame:
    return instances.groupBy(*by).agg(F.count("*").alias("size"))


def make_bags(
    instances: DataFrame, n: int = 9, seed: int = SEED, hot_rows: int = HOT_ROWS, by: tuple[str, ...] = ("slide",)
) -> DataFrame:
    """(by, bag_n, ord, instance): disjoint random groups of n per slide, or per slide and sample.

    A short last bag is topped up from the group's other bags, by a second draw.
    """
    ranked = _slide_rank(instances.select(*by, "instance"), seed, hot_rows, by=by)
    sized = ranked.join(_slide_sizes(instances, by), list(by))
    place = F.col("rank") - 1
    own = sized.select(*by, "instance", F.floor(place / n).alias("bag_n"), (place % n).cast("int").alias("ord"))
    short = F.col("size") % n
    others = sized.filter((short > 0) & (F.col("rank") <= F.col("size") - short))
    drawn = others.withColumn("_d", draw("instance", seed=f"{seed}b"))
    top = first_n(drawn, list(by), "_d", "instance", n - 1, "_r").filter(F.col("_r") <= n - short)
    fill = top.select(*by, "instance", F.floor(F.col("size") / n).alias("bag_n"), (short + F.col("_r") - 1).cast("int").alias("ord"))
    return own.unionByName(fill)


def bag_key(bags: DataFrame, by: tuple[str, ...] = ("slide",)) -> DataFrame:
    """One column that names a bag: `<slide>_<bag_n>`."""
    return bags.withColumn("bag", F.concat_ws("_", *[F.col(c).cast("string") for c in (*by, "bag_n")]))


def bag_class_freq(labelled: DataFrame, n_classes: int) -> DataFrame:
    """Bags per label, zero for absent ones."""
    counts = labelled.agg(*[F.count_if(F.col("label") == c).alias(str(c)) for c in range(n_classes)])
    return counts.select(F.posexplode(F.array(*[F.col(str(c)) for c in range(n_classes)])).alias("label", "n"))


def bag_problems(bags: DataFrame, features: DataFrame, labelled: DataFrame, n: int) -> DataFrame:
    """(bag, problem): bags below n instances, instances without features, labels with unequal bag counts."""
    small = bags.groupBy("bag").agg(F.count("*").alias("_n")).filter(F.col("_n") < n).select("bag", F.lit("too small").alias("problem"))
    bare = (
        bags.join(features.select("instance"), "instance", "left_anti")
        .select("bag").distinct().select("bag", F.lit("no features").alias("problem"))
    )
    counts = labelled.groupBy("label").agg(F.count("*").alias("_n"))
    spread = counts.agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi")).filter("_lo <> _hi")
    uneven = spread.select(F.lit(None).cast("string").alias("bag"), F.lit("labels not balanced").alias("problem"))
    return small.unionByName(bare).unionByName(uneven)


def bag_summary(bags: DataFrame, features: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: number of bags, sum of labels, the rest, and the range and mean of all feature values."""
    v = F.col("embedding")
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    of_features = bags.join(features, "instance").agg(
        F.min(F.array_min(v)).cast("double").alias("feat_min"), F.max(F.array_max(v)).cast("double").alias("feat_max"),
        (F.sum(total) / F.sum(F.size(v))).alias("feat_mean"),
    )
    n, positive = F.count("*"), F.sum("label")
    of_labels = labelled.agg(F.struct(n.alias("n_bags"), positive.alias("n_positive"), (n - positive).alias("n_negative")).alias("l"))
    return of_features.withColumn("_l", of_labels.scalar()).select("_l.*", "feat_min", "feat_max", "feat_mean")


def bag_vectors(bags: DataFrame, features: DataFrame) -> DataFrame:
    """The instance vectors of a bag, in order, end to end. A bag has n instances, so the list is bounded."""
    rows = bags.join(features.select("instance", "embedding"), "instance")
    listed = rows.groupBy("bag").agg(F.sort_array(F.collect_list(F.struct("ord", "embedding"))).alias("_v"))
    return listed.select("bag", F.flatten(F.transform("_v", lambda s: s["embedding"])).alias("vector"))


def pad_small_slides(instances: DataFrame, n: int = 9, false_positive: int = 2, seed: int = SEED) -> DataFrame:
    """Extra (slide, instance, ord) for slides below n: their own false positives first, then others'.

    The false positives of all slides form one ranked pool. A slide that needs r more after its own reads
    r + own consecutive places from a start drawn for it, skips its own and keeps r, so slides and pool
    meet by an equality on the place and no slide is paired with the whole pool. ord counts from 1.
    """
    fp = instances.filter(F.col("class") == false_positive)
    sizes = instances.groupBy("slide").agg(
        F.count("*").alias("size"), F.count_if(F.col("class") == false_positive).alias("own")
    )
    short = sizes.filter(F.col("size") < n).withColumn("lack", n - F.col("size"))
    own_order = Window.partitionBy("slide").orderBy("_d", "instance")
    own = (
        fp.join(short, "slide")  # a short slide holds fewer than n instances
        .withColumn("_d", draw("instance", seed=seed)).withColumn("ord", F.row_number().over(own_order))
        .filter(F.col("ord") <= F.col("lack")).select("slide", "instance", "ord")
    )
    drawn = fp.withColumn("_d", draw("instance", seed=seed))
    pool = split_rank(drawn, [], [slot(F.col("_d"))], ["_d", "instance"], "place").select(
        F.col("slide").alias("owner"), "instance", "place"
    )
    n_pool = fp.agg(F.count("*")).scalar()
    open_ = short.filter(F.col("lack") > F.col("own"))
    start = F.conv(F.substring(draw("slide", seed=f"{seed}s"), 1, 12), 16, 10).cast("bigint")
    reach = F.least(F.col("lack"), n_pool)  # (lack − own) more, and at most `own` places to skip
    asked = open_.filter(reach > 0).select(
        "slide", "own", "lack", (start % n_pool).alias("_start"), F.explode(F.sequence(F.lit(0), reach.cast("int") - 1)).alias("step")
    ).withColumn("place", (F.col("_start") + F.col("step")) % n_pool + 1)
    seen = Window.partitionBy("slide").orderBy("step")
    borrowed = (
        asked.join(pool, "place").filter("owner <> slide")
        .withColumn("_r", F.row_number().over(seen)).filter(F.col("_r") <= F.col("lack") - F.col("own"))
        .select("slide", "instance", (F.col("own") + F.col("_r")).cast("int").alias("ord"))
    )
    return own.unionByName(borrowed)


def balance_bags(
    instances: DataFrame, bags_per_label: DataFrame, labels: DataFrame, n: int = 9, seed: int = SEED, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """New bags (slide, label, turn, ord, instance) that bring every label up to the most frequent one.

    New bags go round the label's slides that hold at least n instances. A slide's turn t takes the places
    t·n … t·n+n−1 of its random order, starting over at the end. Each instance works out the turns it is
    part of, so bags are never matched with instances.
    """
    most = bags_per_label.agg(F.max("n")).scalar()
    able = _slide_sizes(instances).filter(F.col("size") >= n).join(labels, "slide")
    drawn = able.withColumn("_d", draw("slide", seed=seed))
    queue = split_rank(drawn, ["label"], [slot(F.col("_d"))], ["_d", "slide"], "seat")
    seats = able.groupBy("label").agg(F.count("*").alias("seats"))
    due = queue.join(seats, "label").join(bags_per_label.select("label", (most - F.col("n")).alias("lack")), "label")
    turns = F.floor((F.col("lack") - F.col("seat")) / F.col("seats")) + 1
    due = due.filter(F.col("lack") >= F.col("seat")).select("slide", "label", "size", turns.alias("turns"))
    ranked = _slide_rank(instances.select("slide", "instance"), seed, hot_rows).join(due, "slide")
    rounds = F.floor((F.col("turns") * n - F.col("rank")) / F.col("size"))
    rows = ranked.filter(rounds >= 0).withColumn("_m", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds)))
    at = F.col("rank") - 1 + F.col("_m") * F.col("size")
    return rows.select("slide", "label", F.floor(at / n).alias("turn"), (at % n).cast("int").alias("ord"), "instance")


def first_bags(bags: DataFrame, n: int) -> DataFrame:
    """The first n bags by key."""
    return bags.select("bag").distinct().orderBy("bag").limit(n)
