"""Clinical features and the models on them (MLlib)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.draws import SEED
from tilewright.operators.sampling import split_stratified
from tilewright.session import checkpointed


def one_hot_clinical(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """Indicator columns `<column>_<value>` for the categorical columns; the other columns stay."""
    kept = [F.col(c) for c in df.columns if c not in values]
    dummies = [(F.col(c) == v).cast("int").alias(f"{c}_{v}") for c, vs in values.items() for v in vs]
    return df.select(*dummies, *kept)


def fit_tree(df: DataFrame, features: list[str], key: str, label: str = "label", test: float = 0.3, depth: int = 5, seed: int = SEED):
    """Entropy tree on a stratified 70/30 split: (model, one row with sizes and test accuracy)."""
    split = split_stratified(df, key, label, test, seed).withColumn("_y", F.col(label).cast("double"))
    train, held = split.filter("fold = 'train'"), split.filter("fold = 'test'")
    tree = DecisionTreeClassifier(impurity="entropy", maxDepth=depth, labelCol="_y", featuresCol="_x", seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), tree]).fit(train)
    return model, _accuracy(model.transform(held), train)


def tree_column(model, features: list[str]) -> Column:
    """The fitted tree as an expression over its feature columns: what it predicts, without the model and its vectors.

    A tree of depth d has at most 2**d leaves, which are read on the driver. Rows may have NaN (it goes right, as in
    the model); a null feature gives null.
    """
    def walk(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(int(node.prediction()))
        split = node.split()
        value = F.col(features[split.featureIndex()]).cast("double")
        if split.getClass().getSimpleName() == "ContinuousSplit":
            left = value <= F.lit(split.threshold())
        else:
            left = value.isin(*list(split.leftCategories()))
        return F.when(left, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull()
    return F.when(known, walk(model.stages[-1]._java_obj.rootNode()))


def fit_bags(df: DataFrame, key: str = "bag", vector: str = "pooled", label: str = "label", test: float = 0.3, seed: int = SEED):
    """Multinomial logistic regression of the bag label on the pooled vector.

    The split and the fit pass over the pooled vectors many times, so they are written out first.
    """
    split = split_stratified(checkpointed(df.select(key, vector, label)), key, label, test, seed).withColumns(
        {"_y": F.col(label).cast("double"), "_x": array_to_vector(F.transform(vector, lambda x: x.cast("double")))}
    )
    train, held = split.filter("fold = 'train'"), split.filter("fold = 'test'")
    model = LogisticRegression(family="multinomial", labelCol="_y", featuresCol="_x", maxIter=50).fit(train)
    return model, _accuracy(model.transform(held), train)


def _accuracy(predicted: DataFrame, train: DataFrame) -> DataFrame:
    hit = (F.col("prediction") == F.col("_y")).cast("int")
    return predicted.agg(F.count("*").alias("n_test"), F.avg(hit).alias("accuracy")).withColumn(
        "n_train", train.agg(F.count("*")).scalar()
    )
