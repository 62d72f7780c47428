from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, copies int")


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def fill(room, weight, given):
    """Water-filling by repeated sharing."""
    got, open_ = dict.fromkeys(room, 0.0), {c for c in room if weight[c] > 0}
    given = min(given, sum(room[c] for c in open_))
    while open_ and given > 1e-9:
        w = sum(weight[c] for c in open_)
        part = {c: min(room[c] - got[c], given * weight[c] / w) for c in open_}
        for c, p in part.items():
            got[c] += p
        given -= sum(part.values())
        open_ = {c for c in open_ if room[c] - got[c] > 1e-9}
    return got


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 1), (1.0, 1), (1.7, 2), (5.0, 3)])
def test_budgets_and_prefixes(spark, share, epochs):
    rows, i = [], 0
    for lang, source, n in (("en", "a", 60), ("en", "b", 5), ("en", None, 9), ("de", "a", 30), ("de", "c", 2), (None, "z", 4), ("fr", "q", 1)):
        for k in range(n):
            rows.append((i, "w " * (1 + (i * 7) % 23), lang, source, 0, 0))
            i += 1
    rows += [(i, None, "en", "a", 0, 0), (i + 1, "", "xx", "only empty", 0, 0), (i + 2, "a b c", "en", "a", 0, 0), (i + 2, "a b c", "en", "a", 0, 0)]
    weights = {"lang": F.when(F.col("mix_lang") == "en", 3).when(F.col("mix_lang") == "fr", 0).otherwise(1)}
    out = mixing.mix(docs(spark, rows), levels(), weights, share=share, max_epochs=epochs).collect()
    assert len(out) == len(rows)
    tokens, used = defaultdict(float), defaultdict(float)
    for r in out:
        at = (r["lang"] or "", r["source"] or "")
        tokens[at] += r["mix_tokens"]
        used[at] += r["mix_copies"] * r["mix_tokens"] + r["mix_part"]
        assert r["mix_part"] < max(1, r["mix_tokens"]) and r["mix_copies"] <= epochs
    room = {a: t * epochs for a, t in tokens.items()}
    langs = {a[0] for a in room}
    top = fill({x: sum(v for a, v in room.items() if a[0] == x) for x in langs}, {x: {"en": 3, "fr": 0}.get(x, 1) for x in langs}, share * sum(tokens.values()))
    for x in langs:
        leaves = {a: v for a, v in room.items() if a[0] == x}
        for a, want in fill(leaves, dict.fromkeys(leaves, 1), top[x]).items():
            assert abs(used[a] - want) <= 5, (a, used[a], want)


def test_cut_is_a_prefix_of_the_seeded_order(spark):
    import hashlib

    rows = [(i, "w " * (3 + i % 5), "en", "a", 0, 0) for i in range(200)]
    out = mixing.mix(docs(spark, rows), levels(), share=0.4, seed=9).collect()
    order = sorted(out, key=lambda r: hashlib.md5(f"9:0:{r['doc_id']}".encode()).hexdigest())
    left = int(0.4 * sum(r["mix_tokens"] for r in out))
    for r in order:
        take = min(left, r["mix_tokens"])
        assert r["mix_copies"] * r["mix_tokens"] + r["mix_part"] == take
        left -= take


def test_no_python_in_the_plan_and_no_rows(spark):
    out = mixing.mix(docs(spark, [(1, "a b", "en", "s", 0, 0)]), levels())
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert [(r["mix_copies"], r["mix_part"]) for r in out.collect()] == [(1, 0)]
    assert mixing.mix(docs(spark, []), levels()).count() == 0


def test_drawn_documents_repeat(spark):
    rows = [(1, "a b", "en", "s", 0, 0), (2, "c d", "en", "s", 0, 0)]
    out = mixing.drawn_documents(mixing.mix(docs(spark, rows), levels(), share=2.0, max_epochs=2), ["doc_id", "text"])
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 1, 2, 2]


def test_many_leaves_are_joined_in_parts(spark, monkeypatch):
    """Beyond the size for a broadcast the leaves are salted: same rows."""
    rows = [(k, "w " * (1 + k % 17), f"l{k % 3}", f"s{k % 5 if k % 2 else 0}", 0, 0) for k in range(400)] + [(None, "a b", None, None, 0, 0)]
    run = lambda: sorted(map(repr, mixing.mix(docs(spark, rows), levels(), share=0.6).collect()))
    few = run()
    monkeypatch.setattr(mixing, "LEAVES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == few
        plan = mixing.mix(docs(spark, rows), levels(), share=0.6)._jdf.queryExecution().executedPlan().toString()
        assert "mix_salt" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
