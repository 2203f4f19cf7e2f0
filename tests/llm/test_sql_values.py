"""Queries with null numbers in their results, against DuckDB, by typed values."""

import os

import duckdb
import pytest

from lexiloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.nullable_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    found = sorted((tuple(r) for r in df.collect()), key=repr)
    known = con.sql(registry.nullable_sql()[name])
    assert df.columns == known.columns
    assert [t.replace("string", "varchar") for _, t in df.dtypes] == [str(t).lower() for t in known.types]
    assert found == sorted(known.fetchall(), key=repr)
