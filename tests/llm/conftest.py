import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest  # noqa: E402

from pyspark.sql import types as T  # noqa: E402


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (None allowed) or (doc_id, text) pairs, with columns whose names an operator might use itself."""

    def make(texts, parts=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        df = spark.createDataFrame(rows, schema).repartition(parts)
        return df.selectExpr("*", "'x' as key", "1 as n", "2 as rank", "'y' as length", "0 as component_id", "3L as n_words", "4 as score", "5 as n_tokens")

    return make


@pytest.fixture(scope="session")
def sf_texts():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


ODD = [None, "", " ", "\n\n", "a", "a a a a a a", "é", "word " * 3000, "\t\x0b\x0c tab", "no-break space", "x" * 5000, "á b\x00c", "<|endoftext|> x<|endoftext|>y"]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD)
