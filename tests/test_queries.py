"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lexiloom.plans import registry

SF = "/root/testdata/sf0.001"


def same(df, sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    a, b = df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda x: x[cols].astype(str).replace({"<NA>": "None", "nan": "None"}).sort_values(cols).reset_index(drop=True)
    assert key(a).equals(key(b))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_without_sql(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
