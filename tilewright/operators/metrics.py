"""Classification metrics over (truth, predicted) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.draws import SEED, draw, slot
from tilewright.operators.quantiles import exact_quantiles
from tilewright.operators.ranks import split_rank
from tilewright.session import stored


def confusion_matrix(df: DataFrame, n_classes: int) -> DataFrame:
    """(truth, predicted, share) for every pair of classes; shares are of all rows."""
    counts = df.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    ids = F.array(*[F.lit(i) for i in range(n_classes)])
    grid = df.sparkSession.range(1).select(F.explode(ids).alias("truth")).withColumn("predicted", F.explode(ids))
    found = grid.join(F.broadcast(counts), ["truth", "predicted"], "left")  # n_classes² rows
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return found.select("truth", "predicted", (F.coalesce("n", F.lit(0)) / total).alias("share"))


def macro_metrics(df: DataFrame) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 averaged over the classes that occur on either side."""
    counts = df.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("truth") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    side = lambda c, tp, fp, fn: F.struct(F.col(c).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    right, wrong = F.when(hit, F.col("n")).otherwise(zero), F.when(hit, zero).otherwise(F.col("n"))
    sides = counts.select(F.inline(F.array(side("truth", right, zero, wrong), side("predicted", zero, wrong, zero))))
    per_class = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return per_class.agg(
        (F.sum("tp") / F.sum(tp + fn)).alias("accuracy"),
        F.avg(share(tp, tp + fp)).alias("precision"),
        F.avg(share(tp, tp + fn)).alias("recall"),
        F.avg(share(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def batch_mean_accuracy(df: DataFrame, key: str, batch: int, seed: int = SEED) -> DataFrame:
    """Mean of the accuracies of batches of `batch` rows in random order; a short last batch weighs the same."""
    hit = (F.col("truth") == F.col("predicted")).cast("int")
    # Slot sizes and ranks are two passes over what may be a join.
    drawn = stored(df.select(draw(key, seed=seed).alias("_d"), key, hit.alias("_hit")), "verdicts")
    ranked = split_rank(drawn, [], [slot(F.col("_d"))], ["_d", key], "_r")
    per_batch = ranked.groupBy(F.floor((F.col("_r") - 1) / batch).alias("_b")).agg(F.avg("_hit").alias("acc"))
    return per_batch.agg(F.count("*").alias("n_batches"), F.avg("acc").alias("accuracy"))


def crop_size(preds: DataFrame, percentile: float = 90.0) -> DataFrame:
    """One row: the given percentile (linear) of w and of h, and the larger as crop size. Sizes are of any unit, and not rounded."""
    found = exact_quantiles(preds, ["w", "h"], [percentile / 100])
    (w,), (h,) = found["w"], found["h"]
    sizes = preds.sparkSession.createDataFrame([(w, h)], "w_size double, h_size double")
    return sizes.withColumn("size", F.greatest("w_size", "h_size"))


def croppable(preds: DataFrame, size: DataFrame, min_w_h: float = 0.0) -> DataFrame:
    """Predictions that fit the crop size and are not below the minimum."""
    limit = size.select("size").scalar()
    return preds.filter((F.col("w") <= limit) & (F.col("h") <= limit) & (F.col("w") >= min_w_h) & (F.col("h") >= min_w_h))
