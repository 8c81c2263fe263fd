"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from accordant.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows):
    return sorted(str(tuple(float(v) if isinstance(v, (float,)) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    want = con.sql(queries.ORACLE[name])
    assert sorted(want.columns) == cols
    got = cells(tuple(r) for r in out.select(cols).collect())
    assert got == cells(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert got
