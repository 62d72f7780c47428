"""A fitted tree as an expression predicts what the model predicts, on every row."""

import pytest
from pyspark.sql import functions as F

from tilewright.operators import clinical
from tilewright.plans import q_models


@pytest.mark.parametrize("depth", [1, 5, 12])
def test_expression_equals_model(spark, depth):
    made = spark.range(3000).selectExpr("id", "hash(id) % 1000 / 7.0D as a", "xxhash64(id) % 50 as b", "id % 3 as c", "case when id % 3 = 0 then 2 when (hash(id) % 1000 / 7.0D) * (xxhash64(id) % 50) > 300 then 1 else 0 end as label")
    names = ["a", "b", "c"]
    model, metrics = clinical.fit_tree(made, names, "id", depth=depth)
    assert metrics.first()["n_test"] > 0
    odd = spark.createDataFrame([(9001, float("nan"), 1, 1), (9002, float("inf"), -1, 9)], "id long, a double, b long, c long")
    rows = made.drop("label").unionByName(odd)
    keep_nan = model.copy()
    keep_nan.stages[0].setHandleInvalid("keep")
    both = keep_nan.transform(rows).withColumn("own", clinical.tree_column(model, names))
    assert both.filter(~F.col("own").eqNullSafe(F.col("prediction").cast("int"))).isEmpty() and both.count() == 3002
    missing = spark.createDataFrame([(1, None, 1, 1)], "id long, a double, b long, c long")
    assert missing.select(clinical.tree_column(model, names)).first()[0] is None


def test_clinical_tree_on_all_patients(spark, sf):
    """Continuous balances: thresholds lie between values, and the expression has the model's."""
    patients = q_models.graded(spark, sf)
    names = [c for c in patients.columns if c not in ("c_custkey", "label")]
    model, _ = clinical.fit_tree(patients, names, "c_custkey")
    both = model.transform(patients).withColumn("own", clinical.tree_column(model, names))
    assert both.filter(F.col("own") != F.col("prediction")).isEmpty()
    plan = patients.select(clinical.tree_column(model, names))._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan
