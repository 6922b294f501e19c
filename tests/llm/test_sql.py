"""Queries that SQL can express, against DuckDB at the smallest scale."""

import duckdb
import pytest

from tesserae.llm import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(*want.columns).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in want.fetchall()), key=repr)
