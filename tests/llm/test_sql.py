"""Every registered query of the training-data operators against its SQL in DuckDB."""

import os

import duckdb
import pytest

from spanloom.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    expected = con.sql(queries.oracle_sql()[name])
    assert names == sorted(expected.columns)
    rows = con.sql(f"SELECT {', '.join(names)} FROM expected").fetchall()
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(rows, key=repr)
