"""Every registered query with an oracle gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

from quillspark.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rounded(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalogue.oracle_sql():
        assert rows
        return
    out = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert rounded(rows) == rounded(tuple(r[i] for i in at) for r in out.fetchall())
