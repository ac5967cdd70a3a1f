"""Queries whose rows SQL gives too."""

import duckdb
import pytest

from framespan.llm import queries

AT = "/root/testdata/sf0.01"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, AT)
    columns = sorted(df.columns)
    with duckdb.connect() as db:
        for t in ("documents", "pages", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
        want = db.sql(queries.oracle_sql()[name])
        assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
        at = [want.columns.index(c) for c in columns]
        rows = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=str) == rows
