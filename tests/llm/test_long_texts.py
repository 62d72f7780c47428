"""Texts longer than a slice of any operator, and streams in batches of seven rows, against the brute-force versions."""

import random

import pytest
from tokenizers import Tokenizer

from tilewright.llm import bytes_dedup, classifier, jaccard, packing, rules, text, tokens, words_dedup
from tilewright.llm.queries import tokenizer

from . import test_bytes_dedup, test_jaccard, test_rules, test_tokens, test_words_dedup

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def long_words(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß,") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    return [rng.choice(vocabulary) for _ in range(n)]


def joined(words):
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))


@pytest.fixture(scope="module")
def words():
    return long_words(560_000)


@pytest.fixture(scope="module")
def rows(words):
    """A text of more words than a slice has bytes, a near copy of it, texts with passages of it, and small ones."""
    assert len(words) > text.SLICE_BYTES
    rng, near = random.Random(2), list(words)
    for at in rng.sample(range(len(near)), 4000):
        near[at] = "Q" + near[at]
    small = [" ".join(words[at : at + 60]) + " end" for at in (0, 5, 300_000, 559_900)]
    return list(enumerate([*small, joined(words), None, "", joined(near), joined(words[:70])]))


def test_words_dedup_of_long_texts(make_docs, rows):
    got = words_dedup.dedup_words(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == test_words_dedup.brute(rows, 20)


def test_bytes_dedup_of_long_texts(make_docs, words):
    body = joined(words[:190_000])
    assert len(body.encode()) > text.SLICE_BYTES
    rows = list(enumerate([body, body[1000:2500] + "x" + body[-900:], None, joined(words[100_000:100_400]), "ab" * 2000]))
    got = bytes_dedup.dedup_bytes(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == test_bytes_dedup.brute(rows, 200)


def test_rules_and_scores_of_long_texts(make_docs, rows):
    got = {r["doc_id"]: r for r in rules.quality_verdicts(make_docs(rows)).collect()}
    for i, t in rows:
        assert (*[got[i][c] for c in rules.COUNTS[:5]], got[i]["base_failed"]) == test_rules.brute(t)
    weights = classifier.train([t or "" for _, t in rows[:4]], [0, 1, 0, 1])
    scores = {r["doc_id"]: r["p"] for r in classifier.with_score(make_docs(rows), weights, "p").collect()}
    assert len(scores) == len(rows) and all(0 <= p <= 1 for p in scores.values())


def test_near_duplicates_of_long_texts(make_docs, rows):
    got = jaccard.near_duplicates(make_docs(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == test_jaccard.brute(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 7)} == {4}


def test_tokens_and_packing_of_long_texts(make_docs, words):
    body = joined(words + words + words)
    assert len(body.encode()) > tokens.SLICE_BYTES
    rows = [(0, "a b"), (1, body), (2, None), (3, joined(words[:3000]))]
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(make_docs(rows), tokenizer("word_bpe_49k.json")).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    packed = packing.pack(make_docs(rows), tokenizer("byte_bpe_50k.json"), capacity=1024).collect()
    used, least = test_tokens.check_packing(packed, rows, 1024)
    assert used <= least + 2


def test_streams_in_small_batches(spark, make_docs, odd_texts):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "7")
    try:
        rows = list(enumerate([*test_jaccard.planted(3), *odd_texts]))
        got = jaccard.near_duplicates(make_docs(rows)).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == test_jaccard.brute(rows)
        rows = list(enumerate([*test_words_dedup.planted(5, 8), *odd_texts]))
        got = words_dedup.dedup_words(make_docs(rows), size=8, gram=3, block=4, shard_bytes=4000).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == test_words_dedup.brute(rows, 8)
        rows = list(enumerate([*test_bytes_dedup.planted(6), *odd_texts]))
        got = bytes_dedup.dedup_bytes(make_docs(rows), size=30, gram=8, shard_bytes=2000).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == test_bytes_dedup.brute(rows, 30)
    finally:
        spark.conf.set(BATCH, before)
