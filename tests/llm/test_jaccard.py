import os
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tilewright.llm import jaccard
from tilewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(i)
    both = defaultdict(int)
    for held in by.values():
        for i in held:
            for j in held:
                if i < j:
                    both[i, j] += 1
    for (i, j), n in both.items():
        (a, s), (b, t) = sets[i], sets[j]
        if a is not None and b is not None and 100 * n >= 75 * (len(s) + len(t) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((str(d), len(s), None if d is None else root(d)) for d, s in sets)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(30) for _ in range(5)]
    docs = []
    for _ in range(25):
        base = text(rng.choice([3, 5, 6, 12, 40, 150, 400]))
        if rng.random() < 0.7:
            at = rng.randrange(len(base))
            base[at:at] = rng.choice(shared)
        docs.append(base)
        for _ in range(rng.choice([0, 1, 2, 8])):
            copy = list(rng.choice(docs[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                what, at = rng.random(), rng.randrange(len(copy))
                if what < 0.4:
                    copy[at] = rng.choice(vocabulary)
                elif what < 0.7 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, rng.choice(vocabulary).upper())
            docs.append(copy)
        docs += [list(rng.choice(shared)) + text(rng.choice([4, 12, 40]))]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 12)])
def test_equals_brute_force(make_docs, odd_texts, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUPS_PER_TASK", 40)
    rows = list(enumerate([*planted(seed), *odd_texts, "one two", "One Two", "x", "x"], start=100))
    rows += [(None, "no key at all here"), (None, "no key at all here")]
    rows += [(7, rows[0][1]), (7, rows[0][1])]  # the smallest key comes last, twice
    got = jaccard.near_duplicates(make_docs(rows, 5)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_given_documents(make_docs, sf_texts):
    got = jaccard.near_duplicates(make_docs(sf_texts)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute(sf_texts)


def test_search_in_a_group_without_pivots():
    rng = random.Random(4)
    sets, words = [], [rng.getrandbits(60) for _ in range(3000)]
    for _ in range(60):
        base = rng.sample(words, 40) + words[:20]
        for _ in range(rng.choice([1, 3])):
            kept = [x for x in base if rng.random() > 0.07]
            sets.append(np.unique(np.array(kept + rng.sample(words, 3), np.uint64)))
    want = jaccard.Links(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    for pivots in (0, 1, 6):
        assert (jaccard.connect(sets, 75, pivots) == want.roots()).all()


def test_long_lists_are_probed_in_parts_or_merged(monkeypatch):
    rng = random.Random(5)
    words = [rng.getrandbits(60) for _ in range(500)]
    sets = [np.unique(np.array([x for x in words[:40] + rng.sample(words, 5) if rng.random() > 0.05], np.uint64)) for _ in range(80)]
    want = jaccard.Links(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    assert 1 < len(set(want.roots().tolist())) < len(sets)
    for probes in (1, 100, 1 << 18):
        monkeypatch.setattr(jaccard, "PROBES", probes)
        for probe in (0, 1, 16, 1000):
            assert (jaccard.connect(sets, 75, 0, probe) == want.roots()).all()


def chain(name):
    """A text and its successive truncations to 80, 64 and 51 %: only neighbours link."""
    return [" ".join(f"{name}{i}" for i in range(n + 4)) for n in (100, 80, 64, 51)]


@pytest.mark.parametrize("others", [0, 1, 2, 3])
def test_small_group_keeps_links_between_closed_sets(others):
    steps = [np.arange(n, dtype=np.uint64) for n in (100, 80, 64, 51)]
    alone = [np.arange(1000 * k, 1000 * k + 90, dtype=np.uint64) for k in range(1, 1 + others)]
    for order in permutations(range(4)):
        root = jaccard.connect([*[steps[x] for x in order], *alone])
        assert root.tolist() == [0, 0, 0, 0, *range(4, 4 + others)], order


def test_chain_of_four_documents(make_docs):
    rows = []
    for k, order in enumerate(permutations(range(4))):
        rows += [(10 * k + i, chain(f"c{k}x")[x]) for i, x in enumerate(order)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(make_docs(rows, 4)).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(5, k) for k in range(50, 90)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)]
    edges += [(None, 3), (8, 8), (5, 50)]
    links = jaccard.Links(2000)
    for a, b in edges:
        if a is not None:
            links.join(a, b)
    want = sorted({(x, links.root(x)) for e in edges if None not in e and e[0] != e[1] for x in e})
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == want
    assert components(df.limit(0)).count() == 0


def test_no_rows(make_docs):
    assert jaccard.near_duplicates(make_docs([])).count() == 0


def test_keys_are_off_the_disk_before_texts_are_compared(spark, make_docs, monkeypatch):
    texts = [f"{' '.join(f'w{k * 7 + j}' for j in range(30))} {k % 3}" for k in range(20)] * 2
    made, seen = [], []

    def kept(df, name, _written=jaccard.written):
        out = _written(df, name)
        made.append((name, out.inputFiles()[0].rpartition("/")[0].removeprefix("file:")))
        seen.append({n for n, path in made if os.path.exists(path)})
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(make_docs(texts)).collect()}
    assert found == {d: c for d, c in enumerate([*range(20)] * 2)}
    assert "keys" in seen[0] and seen[-1] == {"sets", "kept", "links"}
