import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tilewright.llm import jaccard, lines

SPACE = " \t\n\r\x0b\x0c"


def shingles(s, k=lines.SHINGLE):
    return {s[i : i + k] for i in range(len(s) - k + 1)} if len(s) >= k else {s}


def brute(rows, least=lines.LEAST):
    """All pairs of lines, exactly."""
    held, n_lines = [], defaultdict(int)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(SPACE):
                n_lines[d] += 1
                if len(x.strip(SPACE)) >= least and d is not None:
                    held.append(((d, i), shingles(x.strip(SPACE))))
    held = sorted({k: s for k, s in held}.items())
    links = jaccard.Links(len(held))
    by = defaultdict(list)
    for i, (_, s) in enumerate(held):
        for g in s:
            by[g].append(i)
    both = defaultdict(int)
    for at in by.values():
        for i in at:
            for j in at:
                if i < j:
                    both[i, j] += 1
    for (i, j), n in both.items():
        if 100 * n >= 75 * (len(held[i][1]) + len(held[j][1]) - n):
            links.join(i, j)
    gone = defaultdict(list)
    for i, (place, _) in enumerate(held):
        if links.root(i) != i:
            gone[place[0]].append((place[1], *held[links.root(i)][0]))
    return n_lines, gone


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.choice([1, 4, 9, 15, 40])))
    pool = [line() for _ in range(40)]
    docs = []
    for _ in range(50):
        out = []
        for _ in range(rng.randint(0, 9)):
            x = rng.choice(pool) if rng.random() < 0.4 else line()
            if rng.random() < 0.5 and len(x) > 60:
                at = rng.randrange(len(x) - 4)
                x = x[:at] + rng.choice(["é", "zz", ""]) + x[at + rng.randint(0, 2) :]
            out.append(rng.choice(["", "  ", "\t"]) + x + rng.choice(["", " \r"]))
        docs.append("\n".join(out))
    return docs


@pytest.mark.parametrize("seed,block", [(1, 2000), (3, 6)])
def test_equals_brute_force(make_docs, odd_texts, monkeypatch, seed, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "GROUPS_PER_TASK", 30)
    rows = list(enumerate([*planted(seed), *odd_texts, "the same long line of text\n" * 4], start=5))
    rows += [(None, "the same long line of text"), (3, rows[0][1]), (3, rows[0][1])]
    # High recall is a matter of chance at the threshold; many bands make it certain enough to compare.
    got = lines.dedup_lines(make_docs(rows, 4), bands=60, rows=2).collect()
    n_lines, gone = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        d = r["doc_id"]
        if d not in (3, None):
            assert r["n_lines"] == n_lines[d]
        assert [tuple(x) for x in r["removed"] or []] == ([] if d is None else gone[d]), d
        assert r["n_removed"] == len(r["removed"] or [])


def test_recall_with_production_bands(make_docs, sf_texts):
    rows = [*sf_texts, *enumerate(planted(8), start=1000)]
    got = {r["doc_id"]: {x["line"] for x in r["removed"] or []} for r in lines.dedup_lines(make_docs(rows)).collect()}
    _, gone = brute(rows)
    want = {(d, x[0]) for d, at in gone.items() for x in at}
    found = {(d, x) for d, at in got.items() for x in at}
    assert found <= want and len(found) >= 0.98 * len(want) and want


def test_short_lines(make_docs):
    rng = random.Random(5)
    short = ["Read more", "Share this page", "}", "é", "ab", "seven77", "eight888", "a" * 8, "a" * 12, "a" * 19, "nineteen characters", "x y"]
    near = ["page 12 of 34 in all", "page 12 of 34 in al", "sixteen letters.", "sixteen letters!"]
    rows = []
    for d in range(60):
        own = [f"{d}", f"line {d}", "".join(rng.choice("bcdfghjk") for _ in range(rng.randint(1, 19)))]
        rows.append((d, "\n".join(rng.sample([*own, *rng.sample(short, 3), rng.choice(near), "Read more" if d % 3 else " "], 8))))
    got = {r["doc_id"]: [tuple(x) for x in r["removed"] or []] for r in lines.dedup_lines(make_docs(rows, 7)).collect()}
    _, gone = brute(rows, least=0)
    assert got == {d: gone[d] for d, _ in rows}
    assert sum(map(len, got.values())) > 200


def test_short_lines_of_given_documents(make_docs, sf_texts):
    got = {(r["doc_id"], x["line"]) for r in lines.dedup_lines(make_docs(sf_texts)).collect() for x in r["removed"] or []}
    _, gone = brute(sf_texts, least=0)
    text = dict(sf_texts)
    want = {(d, x[0]) for d, at in gone.items() for x in at if len(text[d].split("\n")[x[0]].strip(SPACE)) < 20}
    assert want and len(want & got) >= 0.98 * len(want)


@pytest.mark.parametrize("length,at,linked", [(62, 30, False), (63, 30, True), (13, -1, False), (14, -1, True)])
def test_shortest_line_with_one_edit_found(length, at, linked):
    a = [chr(0x4E00 + i) for i in range(length)]
    b = list(a)
    b[at] = "x"
    one, other = lines._sets(["".join(x).encode() for x in (a, b)], lines.SHINGLE)
    assert lines._alike(one, other, lines.PERCENT) == linked


def test_cut_text(make_docs):
    a, b = "a line that is long enough", "another line that is long enough"
    docs = make_docs([f"{a}\n{b}\n\nx", f"{b}\r\n  {a}\ny", None, a])
    out = {r["doc_id"]: r["text"] for r in lines.without_lines(docs, lines.dedup_lines(docs)).collect()}
    assert out == {0: f"{a}\n{b}\n\nx", 1: "y", 2: None, 3: ""}


def test_no_rows(make_docs):
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_first_occurrences_over_many_calls():
    rng = np.random.default_rng(5)
    seen, known = lines.Seen(), {}
    for k in range(40):
        hashes = rng.integers(0, 400 * (k % 5 + 1), rng.integers(0, 300)).astype(np.uint64)
        node = np.arange(len(hashes)) + 1000 * k
        assert seen.first(hashes, node).tolist() == [known.setdefault(h, n) for h, n in zip(hashes.tolist(), node.tolist())]
    assert sum(len(h) for h, _ in seen.runs) == len(known) and len(seen.runs) <= 12


def test_a_text_longer_than_a_slice(spark, make_docs):
    """Lines of a text of a megabyte, its near-equal lines in another text, and batches of seven rows."""
    unique = [" ".join(f"w{i}x{(i * 7919 + j * 104729) % 99991}" for j in range(9)) for i in range(12_000)]
    assert len("\n".join(unique)) > 512 << 10
    texts = ["\n".join(unique), "\n".join(u + "." for u in unique[::100]), unique[5] + "\n\n" + unique[5], None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = {r["doc_id"]: r for r in lines.dedup_lines(make_docs(texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (rows[0]["n_lines"], rows[0]["n_removed"]) == (12_000, 0)
    assert [tuple(x) for x in rows[1]["removed"]] == [(k, 0, 100 * k) for k in range(120)]
    assert [tuple(x) for x in rows[2]["removed"]] == [(0, 0, 5), (2, 0, 5)]


def test_pairs_are_compared_together_as_each_by_itself():
    texts = [b"a", b"abcdefgh", b"aaaaaaaaaaaaaaaaaaaa", "é€😀 words that are long enough".encode(), b"one line of words that is longer, 1", b"one line of words that is longer, 2"]
    sets = lines._sets(texts, lines.SHINGLE)
    assert [len(s) for s in sets[:3]] == [1, 1, 1] and all((s[1:] > s[:-1]).all() for s in sets)
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    for percent in (1, 75, 93, 94, 100):
        share = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        got = lines._alike_pairs([sets[k] for p in pairs for k in p], percent)
        assert got.tolist() == [share(sets[i].tolist(), sets[j].tolist()) for i, j in pairs]


def test_a_short_line_does_not_change_the_keys_of_others(monkeypatch):
    rng = np.random.default_rng(1)
    counts = np.array([60] * 500 + [1])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    rolled = []
    monkeypatch.setattr(lines.np, "roll", lambda a, *x, _roll=np.roll, **y: rolled.append(len(a)) or _roll(a, *x, **y))
    keys = lines.band_keys(hashes, counts)
    assert np.array_equal(keys[:500], lines.band_keys(hashes[:-1], counts[:-1])) and np.array_equal(keys[500:], lines.band_keys(hashes[-1:], counts[-1:]))
    assert rolled.count(1) >= 30  # the steps of the short line are its own


def test_smallest_node_of_each_text():
    """Keys need not rise within a partition."""
    seen = lines.Seen()
    h = lambda *x: np.array(x, np.uint64)
    assert seen.first(h(7, 8, 7), np.array([50, 60, 40])).tolist() == [40, 60, 40]
    assert seen.first(h(8, 7, 9), np.array([10, 45, 70])).tolist() == [10, 40, 70]
    assert seen.first(h(7, 8, 9), np.array([90, 90, 20])).tolist() == [40, 10, 20]
    assert sum(len(x) for x, _ in seen.runs) == 3


def test_copies_are_neither_compared_nor_joined_one_by_one(make_docs, monkeypatch):
    rng = random.Random(3)
    base = [" ".join(str(rng.randrange(10**6)) for _ in range(14)) for _ in range(5)]
    texts = [f"{base[d % 5]}\n{base[(d + 1) % 5]}\nown {d}" for d in range(60)] + [b + "." for b in base]
    taken, edges = {}, []
    keep, join = lines.written, lines.components
    monkeypatch.setattr(lines, "written", lambda df, name: taken.setdefault(name, keep(df, name)))
    monkeypatch.setattr(lines, "components", lambda e: edges.append(e.count()) or join(e))
    got = {r["doc_id"]: [tuple(x) for x in r["removed"] or []] for r in lines.dedup_lines(make_docs(texts, 4)).collect()}
    _, gone = brute(list(enumerate(texts)))
    assert got == {d: gone[d] for d in range(len(texts))}
    assert {r["node"] for r in taken["line-led"].collect()} == {0, 1, *[(d << lines.LINE_BITS) + 1 for d in (1, 2, 3)], *[d << lines.LINE_BITS for d in range(60, 65)]}
    assert edges[0] <= 5 * 3 + 5  # copies in other partitions, and the near copies


def test_rows_that_repeat_a_key_with_other_texts(make_docs):
    """The lines of such a row are copies by one text and near copies by another: both count."""
    rng = random.Random(9)
    a, b, c = (" ".join(str(rng.randrange(10**6)) for _ in range(14)) for _ in range(3))
    rows = [(1, a), (9, b + "."), (5, a), (5, b), (5, c), (7, c + "!"), (3, "x"), (8, b)]
    for parts in (1, 2, 8):
        got = {(r["doc_id"], x["line"], x["kept_doc"]) for r in lines.dedup_lines(make_docs(rows, parts)).collect() for x in r["removed"] or []}
        assert got == {(5, 0, 1), (7, 0, 1), (8, 0, 1), (9, 0, 1)}, parts


def test_groups_of_any_size_keep_their_links():
    """A chain of lines, of which only neighbours link, hidden among others; every group size has its own way."""
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + i) for i in range(400))
    steps = [text[:n] for n in (400, 320, 256, 205)]
    for size in (2, 3, 4, 5, 12, 40):
        alone = ["".join(chr(0x5000 + rng.randrange(9000)) for _ in range(90)) for _ in range(max(0, size - 4))]
        texts = [*steps[:size], *alone]
        order = rng.sample(range(len(texts)), len(texts))
        own = np.array(order * 2 if size == 5 else order)
        group = np.zeros(len(own), np.int64)
        x, y = lines.group_links(group, own, [t.encode() for t in texts], lines.PERCENT, lines.SHINGLE)
        links = jaccard.Links(len(texts))
        for i, j in zip(own[x].tolist(), own[y].tolist()):
            links.join(i, j)
        assert links.roots().tolist() == [*[0] * min(size, 4), *range(4, len(texts))], size


def test_pairs_are_tested_in_parts(monkeypatch):
    monkeypatch.setattr(lines, "VALUES", 50)
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 12, n)).astype(np.uint64) for n in rng.integers(1, 80, 60)]
    want = [100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2])]
    assert lines._alike_pairs(sets, 75).tolist() == want and 0 < sum(want) < len(want)


def test_characters_are_counted_at_line_edges():
    raw = np.frombuffer("aé€😀 ß\nplain".encode(), np.uint8)
    points, inner = lines._characters(raw)
    text = raw.tobytes().decode()
    edges = np.array([len(text[:n].encode()) for n in range(len(text) + 1)])
    assert points.tolist() == list(map(ord, text)) and lines._before(inner, edges).tolist() == list(range(len(text) + 1))
    plain = np.frombuffer(b"abcdefghij", np.uint8)
    one, other = lines._rolling(plain).grams(8), lines._rolling(plain.astype("<u4")).grams(8)
    assert one.tolist() == other.tolist() == lines.tx.Rolling(lines.tx.mix(plain.astype(np.uint64) + np.uint64(1))).grams(8).tolist()
