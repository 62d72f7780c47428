import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tilewright.llm import conversations as c
from tilewright.llm import edits
from tilewright.llm import queries

SOLID = re.compile("[^\x20\x09-\x0d]")


def cheapest(rows):
    """(cost, audit, [(row or None, role)]) over all repairs, by plain search; rows: (initial, must go, extra)."""

    def follows(last, initial):
        return initial == ("a" if last == "u" else "u") or (last == "" and initial == "s")

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            initial, goes, extra = rows[i]
            cost, said, turns = best(i + 1, last, 0)
            found.append((cost + 3, "D" + said, turns))
            if not goes:
                if follows(last, initial):
                    cost, said, turns = best(i + 1, initial, 0)
                    found.append((cost + extra, "K" + said, ((i, None), *turns)))
                for to in "ua":
                    if follows(last, to):
                        cost, said, turns = best(i + 1, to, 0)
                        found.append((cost + 2 + extra, "R" + said, ((i, to), *turns)))
        if inserted < 3:
            for to in "ua":
                if follows(last, to):
                    cost, said, turns = best(i, to, inserted + 1)
                    found.append((cost + 2, "I" + said, ((None, to), *turns)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def test_audit_is_the_cheapest_and_least():
    """Every sequence of up to four symbols, and long random ones that need several blocks."""
    t = edits.tables()
    assert len(t.vectors) < 256
    kinds = [(r, False, e) for r in "suax" for e in (0, 1)] + [("u", True, 0)]
    draw = random.Random(1)
    cases = [s for n in range(5) for s in itertools.product(kinds, repeat=n)]
    cases += [tuple(draw.choice(kinds) for _ in range(draw.randrange(5, 40))) for _ in range(1500)]
    for rows in cases:
        symbol = edits.symbols(np.array(["suax".index(r) for r, _, _ in rows], np.int64), np.array([g for _, g, _ in rows], bool), np.array([e for _, _, e in rows], np.int64))
        codes, _ = t.blocks(symbol, np.array([0, len(symbol)]))
        audit, cost = t.audit(codes.tolist())
        want_cost, want_audit, turns = cheapest(rows)
        assert (cost, audit) == (want_cost, want_audit), rows
        got = edits.replay(audit, ["suax".index(r) for r, _, _ in rows], edits.EMPTY)
        assert got == [(-1 if r is None else r, {"u": "user", "a": "assistant", None: None}[to]) for r, to in turns]


def expected(rows):
    """What repair must give for one conversation's (turn, role, text), with plain loops."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, symbols = set(), [], []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        symbols.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    cost, audit, turns = cheapest(tuple(symbols))
    repaired = [(rows[i][1] if to is None else {"u": "user", "a": "assistant"}[to], "" if i is None else rows[i][2]) for i, to in turns]
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, repaired


def conversations(draw, n):
    roles = ["user", "assistant", "system", "user", "assistant", "", None, "tool", "User", "ua"]
    texts = ["hi.", "hi.", "ok?", "so", "é!", "no. ", "\t\x0b", "", None, "x ", "a:b\nc!", "long " * 300 + "."]
    out = []
    for conv in [None, *range(n)]:
        for turn in range(draw.choice([1, 1, 2, 5, 9, 17])):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.5 else draw.choice(roles)
            out.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), role, draw.choice(texts)))
    return out


def table(spark, rows, parts=3):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return made.selectExpr("*", "'k' as kind", "1 as at", "2 as part", "'a' as conv", "true as last", "0 as cost")


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("options", [{}, {"most_rows": 4, "segment": 4}, {"most_bytes": 1000, "segment": 1}])
def test_repair_equals_brute_force(spark, options):
    """Whole conversations, and the same cut into segments."""
    rows = conversations(random.Random(len(options)), 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        parts = [r.asDict(recursive=True) for r in c.repair(table(spark, rows), **options).collect()]
        made = {r["conv"]: r for r in c.digests(*c.repair_parts(table(spark, rows), **options)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    given = grouped(rows)
    assert set(made) == set(given) and (len(parts) > len(given)) == bool(options)
    for conv, own in given.items():
        of = sorted((p for p in parts if p["conv"] == conv), key=lambda p: p["part"])
        gaps, blank, duplicate, truncated, illegal, cost, audit, repaired = expected(own)
        for column, want in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal), ("cost", cost)):
            assert sum(p[column] for p in of) == want == made[conv][column], (conv, column)
        assert "".join(p["audit"] for p in of) == audit == made[conv]["audit"]
        assert [(t["role"], t["text"]) for p in of for t in p["turns"]] == repaired
        assert [p["part"] for p in of] == list(range(len(of))) and [p["last"] for p in of] == [False] * (len(of) - 1) + [True]
        assert made[conv]["sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        assert gaps == (made[conv]["turn_most"] - made[conv]["turn_least"] + 1 - made[conv]["turns_distinct"] if made[conv]["turn_most"] is not None else 0)


def test_one_long_conversation_in_segments(spark):
    draw = random.Random(5)
    rows = [(1, k // 2, draw.choice(["user", "assistant"]), draw.choice(["yes.", "no", "t" * 30 + str(k) + "."])) for k in range(3000)]
    rows += [(2, 0, "user", "word " * 300_000), (2, 1, "assistant", "fine.")]
    whole, cut = (c.digests(*c.repair_parts(table(spark, rows), most_rows=m, segment=64)).orderBy("conv").collect() for m in (10_000, 100))
    assert whole == cut and len(whole[0]["audit"]) >= 3000 and whole[1]["audit"] == "KK" and whole[1]["truncated"] == 1


def test_no_rows(spark):
    assert c.repair(table(spark, [(1, 1, "user", "x")]).filter("conv_id = 2")).count() == 0


def test_query_equals_brute_force(spark, sf, tmp_path):
    odd = conversations(random.Random(8), 300)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None if v is None else v + 10**6, t, r, x) for v, t, r, x in odd]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    given = grouped(rows)
    assert set(got) == set(given)
    nothing = 0
    for conv, own in given.items():
        after = []
        for turn, role, text in own:
            role, text = (" " if v is None else v for v in (role, text))
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            after += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        *counts, audit, repaired = expected(after)
        r = got[conv]
        assert [r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] == counts, conv
        assert (r["audit"], r["repaired_sha256"]) == (audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest())
        nothing += not after
    assert nothing
