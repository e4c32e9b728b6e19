"""Every registered query of the graph side against its SQL on the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

from sourceloom.plans import code_queries, detail_queries, detail_sql, queries, queries_sql, stream_queries

DATA = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **detail_queries.QUERIES, **code_queries.QUERIES, **stream_queries.QUERIES}
SQL = {**queries_sql.ORACLE_SQL, **detail_sql.ORACLE_SQL, **code_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL}


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: "-" if pd.isna(v) else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(got.toPandas()) == rows(want)
    assert len(want)
