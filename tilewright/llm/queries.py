"""The dealt operators over their whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer(name: str) -> str:
    """The vocabulary file's place; every executor reads its own installed copy."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixing_levels():
    from pyspark.sql import functions as F

    # The table has no domain, so one is derived from the source's name.
    domain = F.when(F.substring(F.md5("source"), 1, 1) < "8", "web").otherwise("curated")
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    lang = F.when(F.col("mix_lang") == "en", 4).when(F.col("mix_lang").isin("de", "fr"), 2).otherwise(1)
    weights = {"domain": F.when(F.col("mix_domain") == "web", 3).otherwise(2), "lang": lang, "source": F.when(F.col("mix_source") == "src3", 5).otherwise(1)}
    return levels, weights


OP7_SQL = r"""
with d as (select doc_id, case when substr(md5(source), 1, 1) < '8' then 'web' else 'curated' end as l1, coalesce(lang, '') as l2,
           coalesce(source, '') as l3, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::double as n from documents),
leaf as (select l1, l2, l3, sum(n) as n from d group by all),
w1 as (select l1, sum(n) * 2.0::double as room, case l1 when 'web' then 3.0::double else 2.0::double end as w from leaf group by l1),
g1 as (select *, least(floor(0.8::double * sum(room) over () / 2), sum(room) over ()) as given from w1),
a1 as (select *, coalesce(sum(room) over (order by room / w, l1 rows between unbounded preceding and 1 preceding), 0) as before,
       sum(w) over (order by room / w, l1 rows between current row and unbounded following) as later from g1),
f1 as (select *, room * later <= w * (given - before) as full_up from a1),
r1 as (select *, given - coalesce(sum(case when full_up then room end) over (), 0) as rest,
       sum(case when full_up then 0 else w end) over () as open_w,
       sum(case when full_up then 0 else w end) over (order by room / w, l1) as to_w from f1),
b1 as (select l1, case when full_up then room else least(room, floor(to_w * rest / open_w) - floor((to_w - w) * rest / open_w)) end as budget from r1),
w2 as (select l1, l2, sum(n) * 2.0::double as room, case when l2 = 'en' then 4.0::double when l2 in ('de', 'fr') then 2.0::double else 1.0::double end as w
       from leaf group by l1, l2),
g2 as (select w2.*, budget as given from w2 join b1 using (l1)),
a2 as (select *, coalesce(sum(room) over (partition by l1 order by room / w, l2 rows between unbounded preceding and 1 preceding), 0) as before,
       sum(w) over (partition by l1 order by room / w, l2 rows between current row and unbounded following) as later from g2),
f2 as (select *, room * later <= w * (given - before) as full_up from a2),
r2 as (select *, given - coalesce(sum(case when full_up then room end) over (partition by l1), 0) as rest,
       sum(case when full_up then 0 else w end) over (partition by l1) as open_w,
       sum(case when full_up then 0 else w end) over (partition by l1 order by room / w, l2) as to_w from f2),
b2 as (select l1, l2, case when full_up then room else least(room, floor(to_w * rest / open_w) - floor((to_w - w) * rest / open_w)) end as budget from r2),
w3 as (select l1, l2, l3, n * 2.0::double as room, case l3 when 'src3' then 5.0::double else 1.0::double end as w from leaf),
g3 as (select w3.*, budget as given from w3 join b2 using (l1, l2)),
a3 as (select *, coalesce(sum(room) over (partition by l1, l2 order by room / w, l3 rows between unbounded preceding and 1 preceding), 0) as before,
       sum(w) over (partition by l1, l2 order by room / w, l3 rows between current row and unbounded following) as later from g3),
f3 as (select *, room * later <= w * (given - before) as full_up from a3),
r3 as (select *, given - coalesce(sum(case when full_up then room end) over (partition by l1, l2), 0) as rest,
       sum(case when full_up then 0 else w end) over (partition by l1, l2) as open_w,
       sum(case when full_up then 0 else w end) over (partition by l1, l2 order by room / w, l3) as to_w from f3),
b3 as (select l1, l2, l3, case when full_up then room else least(room, floor(to_w * rest / open_w) - floor((to_w - w) * rest / open_w)) end as budget from r3),
e as (select l1, l2, l3, leaf.n as total, case when leaf.n > 0 then floor(budget / leaf.n)::bigint else 0 end as epochs, budget
      from leaf join b3 using (l1, l2, l3)),
x as (select d.*, epochs, budget - epochs * total as remain, md5('1:' || epochs || ':' || coalesce(doc_id::varchar, '')) as draw
      from d join e using (l1, l2, l3)),
u as (select l1, l2, l3, draw, sum(n) as unit from x where n > 0 group by all),
s as (select *, sum(unit) over (partition by l1, l2, l3 order by draw) as stop from u),
t as (select x.*, least(greatest(remain - stop + unit, 0), unit) as taken, unit from x left join s using (l1, l2, l3, draw))
select doc_id, l1 as domain, l2 as lang, l3 as source, n::bigint as n_tokens,
       case when n = 0 then 0 else epochs + case when floor(taken * n / unit) = n then 1 else 0 end end::bigint as copies,
       case when n = 0 or floor(taken * n / unit) = n then 0 else floor(taken * n / unit) end::bigint as part_tokens
from t
"""


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.mixing import mix

    levels, weights = mixing_levels()
    out = mix(table(spark, sf_dir, "documents"), levels, weights, share=0.8, max_epochs=2)
    named = {"mix_domain": "domain", "mix_lang": "lang", "mix_source": "source", "mix_tokens": "n_tokens", "mix_copies": "copies", "mix_part": "part_tokens"}
    return out.selectExpr("doc_id", *[f"{a} as {b}" for a, b in named.items()])


OP5_SQL = """
with c as (select vec_id, list_reduce(list_transform(range(64), lambda i: case when embedding[i + 1] > 0 then 1::ubigint << i else 0::ubigint end),
           lambda a, b: a | b) as code from embeddings),
p as (select q.vec_id as query_id, x.vec_id as neighbor_id, bit_count(xor(q.code, x.code))::int as distance
      from c q join c x on q.vec_id % 100 = 0 and x.vec_id <> q.vec_id)
select query_id, neighbor_id, rank::int as rank, distance
from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from p) where rank <= 10
"""


@query("op5_exact_top_k", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op10_ngram_jaccard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.bytes_dedup import dedup_bytes

    return dedup_bytes(table(spark, sf_dir, "documents"), size=200).drop("kept")


@query("op1_fm_index_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.words_dedup import dedup_words

    return dedup_words(table(spark, sf_dir, "documents"), size=20).drop("kept")


@query("op11_benchmark_decontamination")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.contamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, texts=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest", "over_limit",
    )


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by hash ends in repetitions of a stretch of its words."""
    from pyspark.sql import functions as F

    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = hashed.withColumn("g", F.expr("h div 10")).withColumn("words", chosen).withColumn("n", F.size("words"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    text = F.array_join(F.transform("words", lambda w, i: F.get("words", at(i))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.periodic import collapse_runs

    found = collapse_runs(looped(table(spark, sf_dir, "documents")), min_length=24, min_times=3)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    # The runs come by start and period, so of equal ratios the first stays.
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), more)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the hash of conversation and turn; what is null reads as one space."""
    from pyspark.sql import functions as F

    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    read = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("d")
    )
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = read.filter("d <> 0").withColumns({"text": text, "role": F.when(F.col("d") == 4, "user").otherwise(F.col("role"))})
    return changed.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("d", "copy")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tilewright.llm.conversations import digests, repair_parts

    given = table(spark, sf_dir, "conversations")
    found = digests(*repair_parts(damaged(given)))
    every = given.select("conv_id").distinct()
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    gaps = F.coalesce(F.expr("turn_most - turn_least + 1 - turns_distinct"), F.lit(0)).cast("bigint").alias("gaps")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", gaps, *map(count, ["blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
