import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tilewright.llm import packing, tokens
from tilewright.llm.queries import tokenizer

MIXED = ["a b", " a  b ", "x <|endoftext|> y<|startoftext|>z", "é a ́b", "a \n b", "it's I'll  don't 's x", "12 34 5!! a ,b", "x\n\ny z\n q",
         "é\nÉ à,b ×x ÷", "don|t <|ENDOFTEXT|> l’été œuf", "ß ẞ İx", "Ab.Cd\nEf, gh%%% IJ!! | k"]


def test_counts_equal_whole_texts(make_docs, odd_texts, sf_texts):
    texts = [*odd_texts, *MIXED, *[t for _, t in sf_texts[:60]], "dup", "dup"]
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokens.token_counts(make_docs(texts), tokenizer("word_bpe_49k.json"), limit=50).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 50), text


def test_no_rows(make_docs):
    assert tokens.token_counts(make_docs([]), tokenizer("word_bpe_49k.json")).count() == 0
    assert packing.pack(make_docs([]), tokenizer("byte_bpe_50k.json")).count() == 0


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[key], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] <= capacity and (len(ids) > capacity or r["length"] == len(ids)) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_round_trip(make_docs, odd_texts, sf_texts, capacity):
    texts = list(enumerate([*odd_texts, *MIXED, *[t for _, t in sf_texts]]))
    rows = packing.pack(make_docs(texts), tokenizer("byte_bpe_50k.json"), capacity=capacity).collect()
    used, least = check_packing(rows, texts, capacity)
    assert used <= least * 1.05 + 20


def test_repeated_rows_are_packed_as_often(make_docs):
    rows = packing.pack(make_docs([(1, "same words"), (1, "same words"), (None, "no key")]), tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1]


def test_plan_places_every_item_once():
    rng = np.random.default_rng(5)
    for n in (1, 7, 400, 20000):
        lengths = np.concatenate([rng.integers(1, 1025, n), np.full(n // 3, 1024), np.full(n, 3)])
        counts = {int(s): int(k) for s, k in zip(*np.unique(lengths, return_counts=True))}
        room, seen = defaultdict(int), defaultdict(list)
        for length, number, k, first in packing.plan(counts):
            for i in range(k):
                room[first + i] += length
                seen[length].append(number + i)
        assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(k)) for s, k in counts.items()}
        assert max(room.values()) <= 1024
        assert len(room) <= 1.03 * lengths.sum() / 1024 + 60
