import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tilewright.llm import periodic as p
from tilewright.llm.queries import QUERIES, looped

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w, min_length=24, times=3):
    """(start, length, smallest period) of every run, by comparing words at every distance."""
    best = {}
    for q in range(1, len(w) // times + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(min_length, times * q):
                best.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def found(words):
    code = np.array([zlib.crc32(x.encode()) for x in words], np.uint64)
    return [(s, e - s, q) for s, e, q in p.find_runs(code, np.array([0, len(words)])).tolist()]


def said(draw, kind):
    letters = "ab" if kind % 2 else "abcdefgh"
    stretch = lambda n: [draw.choice(letters) for _ in range(n)]
    if kind < 2:
        return stretch(draw.randrange(120))
    out = []
    for _ in range(draw.randrange(1, 5)):
        unit = stretch(draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64]))
        if draw.random() < 0.3:
            unit = unit * draw.randrange(1, 4) + stretch(1)
        out += stretch(draw.choice([0, 0, 1, 5])) + unit * draw.randrange(1, 9) + unit[: draw.randrange(len(unit) + 1)]
    return out


@pytest.mark.parametrize("kind", range(4))
def test_equals_brute_force(kind):
    draw = random.Random(kind)
    for _ in range(120):
        words = said(draw, kind)
        assert found(words) == brute(words), " ".join(words)


def test_blocks_shorter_than_the_scale(monkeypatch):
    """Blocks of at most 16 words at all larger scales."""
    monkeypatch.setattr(p, "LARGEST_BLOCK", 16)
    draw = random.Random(9)
    for _ in range(100):
        words = said(draw, 2 + draw.randrange(2))
        words += words[: len(words) // 3] * 4
        assert found(words) == brute(words), " ".join(words)


def test_rows_of_a_slice_are_apart():
    draw = random.Random(4)
    rows = [said(draw, k % 4) for k in range(60)] + [["a"] * 30, ["a"] * 30, []]
    code = np.array([zlib.crc32(x.encode()) for r in rows for x in r], np.uint64)
    before = np.append(0, np.cumsum([len(r) for r in rows]))
    want = [(before[k] + s, before[k] + s + n, q) for k, r in enumerate(rows) for s, n, q in brute(r)]
    assert [tuple(r) for r in p.find_runs(code, before).tolist()] == want


def test_convolution_is_exact():
    """Against direct comparison, up to the largest block and with all its words different."""
    rng = np.random.default_rng(1)
    for size in (8, 64, 1024):
        blocks = np.stack([rng.integers(0, 3, size), np.arange(size), np.zeros(size, np.int64), rng.permutation(size)])
        windows = np.stack([rng.integers(0, 3, 2 * size), np.arange(2 * size) % size, np.zeros(2 * size, np.int64), rng.integers(0, size, 2 * size)])
        windows[3, 5 : 5 + size] = blocks[3]
        want = np.stack([[np.array_equal(w[j : j + size], b) for j in range(size)] for b, w in zip(blocks, windows)])
        assert (p.zero_mismatch(blocks, windows) == want).all()


def test_long_texts(make_docs):
    """Runs with a period above the largest block, in a text above a slice; one word 200,000 times; nothing at all."""
    rng = np.random.default_rng(2)
    unit = [f"w{i}" for i in rng.integers(0, 1 << 30, 5000)]
    long_run = ["x"] + unit * 12 + unit[:77]
    none = [f"v{i}" for i in range(150_000)]
    texts = [" ".join(long_run), "a " * 200_000, " ".join(none)]
    assert all(len(t) > 300_000 for t in texts)
    rows = {r["doc_id"]: r for r in p.collapse_runs(make_docs(texts)).collect()}
    assert [tuple(r) for r in rows[0]["runs"]] == [(1, 60077, 5000)] and rows[0]["collapsed"].split() == ["x", *unit]
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, 200_000, 1)] and rows[1]["collapsed"] == "a"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == texts[2]


def test_odd_texts(make_docs, spark, odd_texts):
    texts = [*odd_texts, "a b " * 30, " é\n" * 24 + "z", "b c " * 12, "b c " * 12, (None, "q " * 50)]
    texts = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = p.collapse_runs(make_docs([*texts, texts[-2]])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(texts) + 1
    given = dict(texts)
    for r in rows:
        w = WORD.findall(given[r["doc_id"]] or "")
        runs = brute(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(w), runs)
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert p.collapse_runs(make_docs([])).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-10, None), (-20, ""), (-30, "one"), (None, "a b"), *[(10**12 + k, "x y z " * 20) for k in range(40)]], "doc_id long, text string")
    changed = {r["doc_id"]: r["text"] for r in looped(docs.select("doc_id", "text").unionByName(odd)).collect()}
    for d in docs.select("doc_id", "text").unionByName(odd).collect():
        w, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        if d["doc_id"] is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            q = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % q] for i, x in enumerate(w)]
        assert WORD.findall(changed[d["doc_id"]] or "") == w
    some = 0
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = QUERIES["op12_periodic_runs"](spark, sf).collect()
    for r in rows:
        w = WORD.findall(changed[r["doc_id"]] or "")
        if len(w) > 1500:
            continue  # too slow for the plain search; test_long_texts has such lengths
        runs = brute(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *want)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        some += bool(runs)
    assert some and len(rows) == docs.count()
