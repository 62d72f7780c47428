import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import bytes_dedup, suffix


def brute(rows, size):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + size] for _, b in bodies for i in range(len(b) - size + 1))
    out = []
    for d, b in bodies:
        off = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                off[i : i + size] = True
        kept = bytes(x for x, o in zip(b, off) if not o)
        spans = sum(1 for i in range(len(b)) if off[i] and (i == 0 or not off[i - 1]))
        out.append((d, len(b), int(off.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(seed, alphabet="abé ", size=30):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randint(size - 2, 3 * size)) for _ in range(6)]
    docs = []
    for _ in range(30):
        t = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(shared) + t[at:]
        docs.append(t)
    copy = rng.choice(docs)
    return docs + [copy] * 5 + [copy[:90] + "Q" + copy[91:]] * 2 + ["ab" * 120, "a" * 100, "a" * 29, "a" * 30]


@pytest.mark.parametrize("seed,crowd", [(1, 50_000), (2, 2)])
def test_equals_brute_force(make_docs, odd_texts, seed, crowd):
    rows = list(enumerate([*planted(seed), *odd_texts]))
    got = bytes_dedup.dedup_bytes(make_docs(rows), size=30, gram=8, crowd=crowd, shard_bytes=2000).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows, 30)


def test_given_documents(make_docs, sf_texts):
    got = bytes_dedup.dedup_bytes(make_docs(sf_texts)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(sf_texts, 200)


def test_keys_null_or_repeated(make_docs):
    t = "".join(random.Random(1).choices("xyz", k=300))
    got = bytes_dedup.dedup_bytes(make_docs([(None, t), (1, t), (1, t), (2, "short")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("None", 0)]
    assert bytes_dedup.dedup_bytes(make_docs([])).count() == 0


def test_suffix_arrays_and_prefixes():
    rng = random.Random(5)
    for _ in range(300):
        parts = [bytes(rng.randint(0, rng.choice([0, 1, 2, 250])) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        parts *= rng.randint(1, 3)
        body = b"\xff".join(parts)
        t = np.frombuffer(body, np.uint8)
        order = suffix.suffix_array(t)
        assert order.tolist() == sorted(range(len(body)), key=lambda i: body[i:])
        ends = np.cumsum([len(p) + 1 for p in parts])[:-1] - 1
        shared, before = suffix.common_prefixes(t, order, ends)
        limit = np.append(ends, len(t))[np.searchsorted(ends, np.arange(len(t)), "left")]
        for k in range(1, len(t)):
            i, j = int(order[k]), int(order[k - 1])
            n = 0
            while i + n < limit[i] and j + n < len(t) and body[i + n] == body[j + n]:
                n += 1
            assert (shared[i], before[i]) == (n, j)


def test_suffixes_of_long_repetitions():
    n = 300_000
    assert suffix.suffix_array(np.frombuffer(b"a" * n, np.uint8)).tolist() == list(range(n - 1, -1, -1))
    got = suffix.suffix_array(np.frombuffer(b"ab" * (n // 2), np.uint8))
    assert got.tolist() == [*range(n - 2, -1, -2), *range(n - 1, 0, -2)]
    for few in (0, 64):
        rng = random.Random(few)
        for _ in range(300):
            body = b"\xff".join([bytes(rng.choices(b"abc", k=rng.randint(1, 9))) * rng.randint(1, 30)] * rng.randint(1, 5))
            before, suffix.FEW = suffix.FEW, few
            order = suffix.suffix_array(np.frombuffer(body, np.uint8))
            suffix.FEW = before
            assert order.tolist() == sorted(range(len(body)), key=lambda i: body[i:])
