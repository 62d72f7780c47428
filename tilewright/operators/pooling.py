"""Pooling of a bag's instance vectors with given weights.

Vectors are summed by MLlib's Summarizer, which combines per task before it shuffles; no bag is collected.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(v: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    products = F.zip_with(v, q, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _vector(v: Column) -> Column:
    return array_to_vector(F.transform(v, lambda x: x.cast("double")))


def attention(df: DataFrame, query: list[float], bag: str = "bag", v: str = "embedding") -> DataFrame:
    """(bag, pooled): Σ softmax(query·vector) · vector."""
    scored = df.select(bag, v, dot(F.col(v), query).alias("_s"))
    top = scored.groupBy(bag).agg(F.max("_s").alias("_top"))
    weighed = scored.join(top, bag).withColumn("_w", F.exp(F.col("_s") - F.col("_top")))
    return weighed.groupBy(bag).agg(vector_to_array(Summarizer.mean(_vector(F.col(v)), F.col("_w"))).alias("pooled"))


def attention_weights(df: DataFrame, query: list[float], bag: str = "bag", v: str = "embedding") -> DataFrame:
    """(bag, instance, weight): the softmax weights themselves."""
    scored = df.select(bag, "instance", dot(F.col(v), query).alias("_s"))
    top = scored.groupBy(bag).agg(F.max("_s").alias("_top"))
    raised = scored.join(top, bag).withColumn("_w", F.exp(F.col("_s") - F.col("_top"))).drop("_s", "_top")
    total = raised.groupBy(bag).agg(F.sum("_w").alias("_z"))
    return raised.join(total, bag).select(bag, "instance", (F.col("_w") / F.col("_z")).alias("weight"))


def noisy_and(df: DataFrame, a: float = 10.0, b: float = 0.01, bag: str = "bag", v: str = "embedding") -> DataFrame:
    """(bag, score): a steep, rescaled sigmoid of the mean over all values of the bag."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    total = F.aggregate(F.col(v), F.lit(0.0), lambda acc, x: acc + x)
    mean = df.groupBy(bag).agg((F.sum(total) / F.sum(F.size(v))).alias("_m"))
    low = sigmoid(F.lit(-a * b))
    score = (sigmoid(F.lit(a) * (F.col("_m") - b)) - low) / (sigmoid(F.lit(a * (1 - b))) - low)
    return mean.select(bag, score.alias("score"))


def softmax_mean(df: DataFrame, gate=None, bag: str = "bag", v: str = "embedding") -> DataFrame:
    """(bag, pooled): per feature, the softmax over the instances' gate scores weighs the feature.

    `gate` maps the vector to scores of the same length; by default the vector is its own score.
    """
    values = F.transform(v, lambda x: x.cast("double"))
    scored = df.select(bag, values.alias("_v"), (values if gate is None else gate(values)).alias("_g"))
    top = scored.groupBy(bag).agg(vector_to_array(Summarizer.max(array_to_vector(F.col("_g")))).alias("_top"))
    raised = scored.join(top, bag).withColumn("_e", F.zip_with("_g", "_top", lambda x, m: F.exp(x - m)))
    sums = raised.groupBy(bag).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_e")))).alias("_z"),
        vector_to_array(Summarizer.sum(array_to_vector(F.zip_with("_e", "_v", lambda e, x: e * x)))).alias("_p"),
    )
    return sums.select(bag, F.zip_with("_p", "_z", lambda p, z: p / z).alias("pooled"))
