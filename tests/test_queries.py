"""Every registered query of the library against its SQL, by rows and by types."""

import duckdb
import pytest

from framespan.queries import ORACLES, QUERIES

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
        yield connection


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=str) == rows


#: Each joins a table of one row: the peak of all, totals, the ranges that a user gave.
ONE_ROW = {"q_peak_normalize", "q_stats", "q_range_override"}


def test_plans_do_not_cross_join(spark):
    for name, f in QUERIES.items():
        plan = f(spark, AT)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan or name in ONE_ROW, name
