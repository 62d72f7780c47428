import numpy as np
from pyspark.sql import functions as F

from tilewright.llm import search


def brute(codes, ids, asked, k):
    out = []
    for i in asked:
        far = sorted((int(np.bitwise_count(codes[i] ^ codes[j])), ids[j]) for j in range(len(ids)) if j != i)
        out += [(ids[i], x, r + 1, d) for r, (d, x) in enumerate(far[:k])]
    return sorted(out)


def vectors(spark, codes, ids):
    rows = [(int(i), [1.0 if int(c) >> b & 1 else -1.0 for b in range(64)], "x", 7) for c, i in zip(codes, ids)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string, distance int")


def test_equals_brute_force_with_hot_codes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(300)], np.uint64)
    codes = np.concatenate([base[rng.integers(0, 6, 300)] ^ flips, np.repeat(base[:1], 150), rng.integers(0, 1 << 63, 60, dtype=np.uint64)])
    ids = np.arange(len(codes)) * 10
    for block in (100_000, 150):
        monkeypatch.setattr(search, "BLOCK_CODES", block)
        monkeypatch.setattr(search, "BLOCK_QUERIES", max(10, block // 10))
        got = search.top_k(vectors(spark, codes, ids), F.col("vec_id") % 100 == 0, k=7).collect()
        assert sorted(map(tuple, got)) == brute(codes, ids.tolist(), range(0, len(codes), 10), 7)


def test_odd_rows(spark):
    rows = [(0, [1.0] * 64), (0, [1.0] * 64), (100, None), (1, []), (None, [1.0] * 64), (200, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, search.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()))
    assert {(a, b) for a, b, _, _ in got} == {(0, 1), (0, 200), (200, 0), (200, 1)}
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert search.top_k(df.filter("vec_id = 1"), F.lit(True)).count() == 0
