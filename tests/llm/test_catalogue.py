"""Every query that SQL can express against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tilewright.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
