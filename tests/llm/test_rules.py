import re
from collections import Counter

import numpy as np

from tilewright.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JUNK = ["a b c d\na b c d\n\n  \na b c d", "one two three one two three", "x\ny\nx\n y\r\n y", "one# two$ |", "é è é è é è é", "A B\x0bA B\x0cA B", "\nq\n"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(make_docs, odd_texts, sf_texts):
    texts = [*odd_texts, *JUNK, "dup", "dup", *[t for _, t in sf_texts]]
    got = {r["doc_id"]: r for r in rules.quality_verdicts(make_docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (*[r[c] for c in rules.COUNTS[:5]], r["base_failed"]) == brute(t), t
        assert not (r["base_failed"] and r["kept"])


def test_estimation_recovers_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    on_good, on_bad = np.array([0.97, 0.8, 0.9, 0.95, 0.85]), np.array([0.6, 0.85, 0.7, 0.5, 0.8])
    right = rng.random((len(good), 5)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 5)) < 0.7)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    a, b, prior, posterior = rules.estimate(patterns.astype(float), n.astype(float))
    assert max(np.abs(a - on_good).max(), np.abs(b - on_bad).max()) < 0.06 and abs(prior - 0.8) < 0.04
    assert (((posterior >= 0.5)[at.ravel()]) == good).mean() > 0.9


def test_clean_kept_and_junk_rejected(spark):
    from tilewright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_quality_rules"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_no_rows(make_docs):
    assert rules.quality_verdicts(make_docs([])).count() == 0
