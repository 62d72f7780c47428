"""Every stage of the pipeline against a plain version, on the stage's own input."""

import random
import re

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_jaccard import brute as jaccard_groups
from tests.llm.test_lines import brute as line_groups
from tests.llm.test_tokens import check_packing
from tilewright.llm import classifier
from tilewright.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of each stage, each written and read again."""
    sf = "/root/testdata/sf0.001"
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(900, None, "en", "s", 0), (901, "", None, None, None), (902, "  ", "en", "s", 2), (903, "x " * 9000, "en", "src0", 18000), (None, "no id", "en", "s", 5)],
        docs.schema,
    )
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id in (3, 4)"))
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs.collect())
    return out


def test_columns(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after and list(after[0].asDict()) == cp.COLUMNS, name


def test_quality(spark, stages):
    before, after = stages["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    w = classifier.fit(spark.createDataFrame(before), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    want = [r for r in before if classifier._probabilities(w.astype("f4"), __import__("pyarrow").array([r["text"]], "string"))[0] >= 0.5]
    assert sorted(after, key=repr) == sorted(want, key=repr)
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in {r["doc_id"] for r in after} for d in good) >= 0.97 * len(good)


def test_lines(stages):
    before, after = stages["line_dedup"]
    _, gone = line_groups([(r["doc_id"], r["text"]) for r in before])
    want = []
    for r in before:
        off = {x[0] for x in gone.get(r["doc_id"], [])} if r["doc_id"] is not None else set()
        if not off:
            want.append(tuple(r))
            continue
        t = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in off)
        if WORD.search(t):
            want.append((r["doc_id"], t, r["lang"], r["source"], len(t)))
    assert sorted(map(tuple, after), key=repr) == sorted(want, key=repr)


def near_groups(rows, originals):
    """Smallest id of each document's group: links between texts as they are and, where much is gone, as they stood in `originals`."""
    was, now = {}, {}
    for held, own in ((was, originals), (now, rows)):
        for d, t in own:
            held[d] = max(held.get(d, -1), -1 if t is None else len(t))
    cut = {d for d in now if d in was and 0 <= now[d] < (1 - cp.LOST) * was[d]}
    forms = [(2 * d, t) for d, t in rows if d is not None] + [(2 * d + 1, t) for d, t in originals if d in cut]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, _, c in jaccard_groups(forms):
        x, y = root(int(d) >> 1), root(c >> 1)
        up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def test_near_duplicates(spark, stages):
    before, after = stages["ngram_jaccard"]
    originals = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    groups = near_groups([(r["doc_id"], r["text"]) for r in before], originals)
    want = {tuple(r) for r in before if r["doc_id"] is None or groups[r["doc_id"]] == r["doc_id"]}
    assert sorted(map(tuple, after), key=repr) == sorted(want, key=repr)


def test_near_copies_leave_no_fragments(spark, tmp_path):
    """Copies with a word replaced in some lines: line dedup takes the other lines, and the next stage what is left."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(3, 9)))
    line = lambda: [word() for _ in range(draw.randrange(8, 16))]
    rows, near = [], set()
    for k in range(60):
        body = [line() for _ in range(draw.randrange(6, 14))]
        rows.append((k, body))
        if k < 40:
            for j in draw.sample(range(len(body)), 1 + len(body) // 5):
                body = [*body[:j], [*body[j][:4], word(), *body[j][5:]], *body[j + 1 :]]
            rows.append((1000 + k, body))
            near.add(1000 + k)
    rows = [(d, "\n".join(" ".join(w) for w in body), "en", "s", 0) for d, body in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = [tuple(r) for r in cp.line_dedup(spark, docs, str(tmp_path)).collect()]
    kept = cp.near_duplicates(spark, spark.createDataFrame(cut, docs.schema), str(tmp_path)).collect()
    left = {r["doc_id"] for r in kept}
    linked = {d for d, r in near_groups([(r[0], r[1]) for r in rows], [(r[0], r[1]) for r in rows]).items() if d != r}
    fragments = {r[0] for r in cut} & linked
    assert len(linked) >= 36 and fragments and not left & linked
    assert left == set(range(60)) | (near - linked)
    assert {r["doc_id"]: r["text"] for r in kept if r["doc_id"] < 60} == {d: t for d, t, *_ in rows if d < 60}


def test_mixing(stages):
    before, after = stages["mixing"]
    words = lambda rows: sum(len(WORD.findall(r["text"] or "")) for r in rows)
    longest = max(len(WORD.findall(r["text"] or "")) for r in before)
    leaves = len({(r["lang"], r["source"]) for r in before})
    assert set(map(tuple, after)) <= set(map(tuple, before)) and len(set(map(tuple, after))) == len(after)
    assert 0.9 * words(before) - 1 <= words(after) <= 0.9 * words(before) + leaves * longest


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    used, least = check_packing(after, [(r["doc_id"], r["text"]) for r in before], 1024)
    assert used <= 1.05 * least + 10


def test_run_gives_the_stages_result(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) > 100
