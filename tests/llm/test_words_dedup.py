import hashlib
import random
import re

import numpy as np
import pytest

from tilewright.llm import words_dedup
from tilewright.llm.fm_index import FMIndex, WaveletMatrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        off = [False] * len(w)
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in seen:
                off[i : i + size] = [True] * size
            seen.add(g)
        kept = " ".join(x for x, o in zip(w, off) if not o)
        out.append((d, len(w), sum(off), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def planted(seed, size):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(["a", "b", "é", "dd", "e,"]) + rng.choice(["", "1"]) for _ in range(n)]
    shared = [text(rng.randint(size - 1, 3 * size)) for _ in range(8)]
    docs = []
    for _ in range(40):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(shared) + t[at:]
        docs.append(t)
    copy = max(docs, key=len)
    docs += [copy] * 4 + [copy[:20] + ["Q"] + copy[21:]] * 2 + [["x"] * 60, ["x", "y"] * 30]
    rng.shuffle(docs)
    return [rng.choice([" ", "\n", " \t"]).join(d) for d in docs]


@pytest.mark.parametrize("seed,size,block,crowd", [(1, 20, 5, 50_000), (2, 8, 4, 50_000), (3, 8, 2, 2), (4, 6, 6, 50_000)])
def test_equals_brute_force(make_docs, odd_texts, seed, size, block, crowd):
    rows = list(enumerate([*planted(seed, size), *odd_texts]))
    got = words_dedup.dedup_words(make_docs(rows), size=size, gram=3, block=block, crowd=crowd, shard_bytes=4000).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows, size)


def test_given_documents(make_docs, sf_texts):
    got = words_dedup.dedup_words(make_docs(sf_texts)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(sf_texts, 20)


def test_keys_null_or_repeated(make_docs):
    t = " ".join(f"w{i}" for i in range(40))
    got = words_dedup.dedup_words(make_docs([(None, t), (1, t), (1, t), (2, t), (3, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [("1", 40, 0), ("1", 40, 0), ("2", 40, 40), ("3", 0, 0), ("None", 40, 0)]
    assert words_dedup.dedup_words(make_docs([])).count() == 0


def test_index_against_plain_search():
    rng = np.random.default_rng(7)
    for top in (1, 2, 9, 300):
        text = np.append(rng.integers(0, top + 1, 500), 0)
        tree = WaveletMatrix(text, int(text.max()).bit_length() or 1)
        symbol, place = rng.integers(0, top + 1, 200), rng.integers(0, len(text) + 1, 200)
        assert tree.rank(symbol, place).tolist() == [int((text[:p] == s).sum()) for s, p in zip(symbol, place)]
        index = FMIndex(text, 3)
        pattern = rng.integers(1, top + 1, (100, 3))
        reach, lo, hi = index.matching(pattern, 3)
        for p, r, a, b in zip(pattern.tolist(), reach, lo, hi):
            at = lambda m: [i for i in range(len(text) - m + 1) if text[i : i + m].tolist() == p[:m]]
            longest = max([m for m in (1, 2, 3) if at(m)], default=0)
            assert r == longest and sorted(index.order[a:b].tolist()) == (at(longest) if longest else [])
