import hashlib
import random
import re

import numpy as np
import pytest

from tilewright.llm import contamination as c
from tilewright.llm.automaton import Automaton, build
from tilewright.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, size):
    w = words(text)
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(text, items, size):
    """(words, hit words, ids of items that occur, spans, longest shared passage at a hit window)."""
    w = words(text)
    hit, ids, longest = [False] * len(w), set(), 0
    subs = [" " + " ".join(words(t)) + " " for _, t in items]
    for name, t in items:
        for win in windows(t, size):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit[i : i + len(win)] = [True] * len(win)
                    ids.add("" if name is None else str(name))
                    lo = i
                    while lo and any(" " + " ".join(w[lo - 1 : i + len(win)]) + " " in s for s in subs):
                        lo -= 1
                    longest = max(longest, i + len(win) - lo)
    spans = [(m.start(), m.end() - m.start()) for m in re.finditer("1+", "".join("01"[h] for h in hit))]
    return len(w), sum(hit), sorted(ids), spans, longest


def check(docs, items, make_docs, spark, size=10, **more):
    table = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as n", "'k' as key")
    got = c.contamination(make_docs(docs), table, size=size, **more).collect()
    assert len(got) == len(docs)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for key, text in docs:
        n, hits, ids, spans, longest = brute(text, items, size)
        for r in by_id[key]:
            assert (r["n_words"], r["n_hit"], sorted(r["items"]), [tuple(s) for s in r["spans"]]) == (n, hits, ids, spans), (text, items)
            assert r["longest"] == longest or (longest == 0) == (r["longest"] == 0) and more
            assert words(r["clean"]) == [w for i, w in enumerate(words(text)) if not any(a <= i < a + k for a, k in spans)]
            assert r["over_limit"] == (hits > 0.2 * n)


@pytest.mark.parametrize("more", [{}, {"shard_words": 12, "per_pass": 2}])
def test_equals_brute_force(make_docs, spark, more):
    """Few different words, so that items, windows and texts overlap in every way; also over several automata and passes."""
    draw = random.Random(7)
    said = lambda n: " ".join(draw.choice("aB c1 D é".replace(" ", "")) for _ in range(n))
    items = [(str(k % 7), said(draw.choice([0, 1, 2, 3, 5, 8, 20]))) for k in range(9)] + [("x", None), (None, "zz yy"), ("y", "q r s t")]
    docs = [(k, said(draw.choice([0, 1, 3, 10, 40]))) for k in range(60)]
    docs += [(100, None), (101, "a Zz-YY, q.r s"), (101, "a Zz-YY, q.r s"), (None, "zz yy"), (102, "zz\x00yy \x7f ! zz  yy")]
    check(docs, items, make_docs, spark, size=4, **more)


def test_short_items_and_their_suffixes(make_docs, spark):
    items = [("1", "b"), ("2", "a b"), ("3", "c a b"), ("4", "b c d e f g h i j k l"), ("5", "B"), ("6", "j k")]
    docs = list(enumerate(["x c a b", "a b c", "b c d e f g h i j k", "c d e f g h i j k l", "d e f g h i j", "no", "j k j k"]))
    check(docs, items, make_docs, spark)


def test_odd_texts_and_very_long_ones(make_docs, spark, odd_texts):
    """A text above a slice, most of it from one item, and one above that without any."""
    item = " ".join(f"w{i % 37}" for i in range(60))
    long_hit = ("lorem " * 50 + item + ". ") * 1500
    clean = "ipsum dolor " * 60_000
    assert len(long_hit) > 512 << 10 and len(clean) > 512 << 10
    rows = c.contamination(make_docs([*odd_texts, long_hit, clean]), spark.createDataFrame([(1, item), (2, "word " * 9 + "word")], "item_id long, text string")).collect()
    by_id = {r["doc_id"]: r for r in rows}
    n = len(odd_texts)
    assert (by_id[n]["n_words"], by_id[n]["n_hit"], len(by_id[n]["spans"]), by_id[n]["items"]) == (110 * 1500, 60 * 1500, 1500, ["1"])
    assert (by_id[n + 1]["n_words"], by_id[n + 1]["n_hit"], by_id[n + 1]["clean"]) == (120_000, 0, clean)
    assert by_id[7]["n_hit"] == 3000 and by_id[7]["items"] == ["2"] and by_id[0]["clean"] == ""


def test_batches_cut_anywhere(spark, make_docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check([(k, f"t{k} a b c d a b {k}") for k in range(50)], [("1", "b c d a"), ("2", "7")], make_docs, spark, size=3, shard_words=4, per_pass=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows_and_no_items(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.contamination(make_docs([]), none).count() == 0
    assert [r["n_hit"] for r in c.contamination(make_docs(["a b", None]), none).collect()] == [0, 0]


def test_automaton_is_linear():
    """At most two states and three steps a word, whatever the items share."""
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 3, n).astype(np.uint64) for n in (0, 1, 500, 2000, 2000)]
    a = Automaton(build(parts, ["i"] * 5, 10))
    total = sum(map(len, parts))
    assert len(a.link) <= 2 * total and len(a.steps) <= 3 * total


def test_query_equals_brute_force(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in QUERIES["op11_benchmark_decontamination"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    index = {}
    for name, t in items:
        for w in windows(t, 10):
            index.setdefault(w, set()).add(str(name))
    sizes = {len(w) for w in index}
    some = 0
    for d in docs:
        w = words(d["text"])
        hit, ids = [False] * len(w), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                found = index.get(tuple(w[i : i + k]))
                if found:
                    hit[i : i + k] = [True] * k
                    ids |= found
        r = rows[d["doc_id"]]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), sum(hit), len(ids), digest, any(hit))
        some += any(hit)
    assert some and len(rows) == len(docs)
