"""Training-data queries with a SQL twin give its rows."""

import os
import sys

import duckdb
import pytest

from weft.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from test_oracles import TABLES, rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    whole = lambda df: df.astype({c: "Int64" for c in df.columns if df[c].dtype.kind in "if"})
    assert rows(whole(got)) == rows(whole(want))
