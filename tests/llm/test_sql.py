"""Queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from lexiloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    a, b = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert key(a).equals(key(b))
