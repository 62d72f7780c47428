"""Exact quantiles against sorted lists, for numbers that equal ranges alone would not part."""

import math
import random

import pytest

from tilewright.operators import quantiles
from tilewright.operators.quantiles import exact_quantiles

SHARES = [0, 0.001, 0.25, 0.5, 0.9, 0.999, 1]


def plain(values, p):
    place = p * (len(values) - 1)
    a, b = values[math.floor(place)], values[math.ceil(place)]
    return a if a == b else a + (b - a) * (place - math.floor(place))


def cases():
    draw = random.Random(11)
    yield "uniform", [draw.random() for _ in range(20_000)]
    yield "magnitudes", [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(20_000)]
    yield "outlier", [draw.random() for _ in range(15_000)] + [1e308, -1e308]
    yield "one value", [0.1] * 9_000
    yield "mostly one value", [0.1] * 9_000 + [draw.gauss(0, 1) for _ in range(500)]
    yield "next to each other", [1.0 + k * 2**-52 for k in range(6_000)]
    yield "small and zero", [0.0] * 5_000 + [5e-324, -5e-324] + [draw.expovariate(1) ** 9 for _ in range(9_000)]
    yield "few", [3.0, 1.0]


@pytest.mark.parametrize("name, values", list(cases()))
def test_equals_sorted_values(spark, name, values):
    rows = [(v, -v) for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, None), (float("nan"), float("nan"))], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], SHARES)
    for column, own in (("a", sorted(values)), ("b", sorted(-v for v in values))):
        assert got[column] == pytest.approx([plain(own, p) for p in SHARES], rel=1e-15, abs=0), column


def test_a_pass_keeps_few_counters(spark, monkeypatch):
    """Half a million different values: no job returns more than the ranges of a pass or one small range."""
    seen = []
    real = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda rows, names, open_: (real(rows, names, open_), seen.append(max(s.rows for s in open_))))
    df = spark.range(500_000).selectExpr("sqrt(id * 1.0) as a")
    got = exact_quantiles(df, ["a"], [0.9])["a"][0]
    assert got == pytest.approx(math.sqrt(449_999) + (math.sqrt(450_000) - math.sqrt(449_999)) * 0.1, rel=1e-12)
    assert len(seen) == 1 and seen[0] <= quantiles.FEW


def test_nothing_and_infinity(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "a double"), ["a"], [0.5]) == {"a": [None]}
    df = spark.createDataFrame([(float(k),) for k in range(9_000)] + [(math.inf,)] * 3 + [(-math.inf,)], "a double")
    assert exact_quantiles(df, ["a"], [0, 0.5, 1])["a"] == [-math.inf, 4500.5, math.inf]
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], [90])
