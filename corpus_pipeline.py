"""From raw documents to packed training sequences: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`. Rows with a null doc_id pass the dedup
stages untouched; null and empty texts are judged like any other text by the classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm import classifier, jaccard, lines, mixing, packing, queries
from tilewright.llm.components import components
from tilewright.llm.store import written

LOST = 0.15
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels of the rows it is given."""
    weights = classifier.fit(docs, queries.table(spark, sf_dir, "labels"))
    return classifier.with_score(docs, weights, "_score").filter("_score >= 0.5").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, nearly or exactly; a document left without words goes."""
    cut = lines.without_lines(docs, lines.dedup_lines(docs), mark="_cut")
    bare = F.col("_cut") & ~F.col("text").rlike(mixing.WORD)
    n_chars = F.when(F.col("_cut"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.filter(~bare).withColumn("n_chars", n_chars).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; of rows that repeat an id, one stays.

    A near copy that has lost its repeated lines is like nothing any more, but must not stay as a fragment. So
    documents are compared as they are and, where they have lost more than `LOST` of their characters, also as they
    stand in `documents`; two documents are of one group if any of their texts link.
    """
    own = docs.filter("doc_id is not null").select("doc_id", "text")
    whole = queries.table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = lambda df, name: df.groupBy("doc_id").agg(F.max(F.length("text")).alias(name))
    cut = sized(own, "_is").join(sized(whole, "_was"), "doc_id").filter(F.col("_is") < (1 - LOST) * F.col("_was")).select("doc_id")
    texts = own.withColumn("doc_id", 2 * F.col("doc_id")).unionByName(whole.join(cut, "doc_id", "left_semi").withColumn("doc_id", 2 * F.col("doc_id") + 1))
    found = jaccard.near_duplicates(texts)
    groups = components(found.select(F.shiftright("doc_id", 1).alias("a"), F.shiftright("component_id", 1).alias("b")))
    gone = groups.filter("node <> component").select(F.col("node").alias("doc_id"))
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    stays = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").withColumn("_r", F.row_number().over(one)).filter("_r = 1")
    return stays.select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared among domains, languages and sources by weight; no document twice."""
    levels, weights = queries.mixing_levels()
    return mixing.drawn_documents(mixing.mix(docs, levels, weights, share=0.9, max_epochs=1), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixture),
    ("best_fit_packing", pack),
]

# Neither the classifier nor the packing can be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
