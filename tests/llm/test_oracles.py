"""Queries that SQL can express give DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

from quillspark.llm import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    out = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in out.fetchall())
