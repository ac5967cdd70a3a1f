"""Queries on whole tables: against their SQL without the filters that it once had, or by brute force."""

import duckdb
import pytest

from framespan.queries import ORACLES, QUERIES
from framespan.sinks.dumps import keep_newest

AT = "/root/testdata/sf0.001"
TABLES = ("lineitem", "conversations", "orders")


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
        yield connection


def equal(spark, db, name, sql):
    df = QUERIES[name](spark, AT)
    want = db.sql(sql)
    rows = sorted((tuple(r) for r in want.fetchall()), key=str)
    assert rows and sorted((tuple(r) for r in df.select(want.columns).collect()), key=str) == rows


@pytest.mark.parametrize("name", ["q_point_in_interval", "q_mix_sum", "q_sidechain", "q_timeline_length", "q_gap_rows"])
def test_layers_hold_all_lines_of_an_order(spark, db, name):
    equal(spark, db, name, ORACLES[name].replace(" WHERE ord <= 3", ""))


def test_fades_of_all_orders(spark, db):
    equal(spark, db, "q_edge_fade", ORACLES["q_edge_fade"].replace(" WHERE src % 10 = 1", ""))


def test_boundaries_of_all_keys(spark, db, tmp_path):
    equal(spark, db, "q_bucket_boundary", ORACLES["q_bucket_boundary"].replace(" % 5000", ""))
    keys = [1, 4999, 5000, 5001, 123_456_789]
    spark.createDataFrame([(k,) for k in keys], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["q_bucket_boundary"](spark, str(tmp_path)).collect()
    want = [(k, (2 * k * 48000 * 1001 + 30000) // 60000, k * 48000 * 1001 // 30000, (k + 7) * 48000 * 1001 // 30000) for k in keys]
    assert sorted(tuple(r) for r in rows) == want


def test_ramps_of_all_clips(spark, db):
    equal(spark, db, "q_keyframe_sample", ORACLES["q_keyframe_sample"].replace(" WHERE ord = 2", ""))


def test_retimed_cues_up_to_the_end_of_each_conversation(spark, db):
    clips = "FROM (SELECT src, unnest(generate_series(0, CAST((length - 1) // 300 AS BIGINT))) AS k FROM len)"
    equal(spark, db, "q_cue_retime", ORACLES["q_cue_retime"].replace("FROM (SELECT DISTINCT src FROM cues), generate_series(0, 3) AS g(k)", clips))


def test_retimed_cue_of_a_long_conversation(spark, tmp_path):
    rows = [(1, 0, "a" * 1150), (1, 1, "b" * 100), (2, 0, "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["src"], r["start"], r["end"], r["text"][0]) for r in QUERIES["q_cue_retime"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 200, "a"), (1, 200, 400, "a"), (1, 400, 600, "a"), (1, 600, 800, "a"), (1, 800, 850, "b"), (2, 0, 1, "c")]


def test_orders_beyond_the_newest(spark, db, tmp_path):
    equal(spark, db, "q_top_oldest", "SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) > 255")
    few = spark.read.parquet(f"{AT}/orders.parquet").limit(255)
    few.write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["q_top_oldest"](spark, str(tmp_path)).count() == 0


def test_newest_of_equal_and_null_entries(spark):
    rows = [("a", 3), ("b", 2), ("b", 2), ("b", 2), (None, 2), ("c", None), ("d", 1)]
    cache = spark.createDataFrame(rows, "path string, mtime long")
    for most, want in ((3, [("c", None), ("d", 1), ("b", 2), ("b", 2)]), (6, [("c", None)]), (7, []), (0, [("c", None), ("d", 1), (None, 2), ("b", 2), ("b", 2), ("b", 2), ("a", 3)])):
        assert [tuple(r) for r in keep_newest(cache, most).collect()] == want
    assert "Window" not in keep_newest(cache)._jdf.queryExecution().executedPlan().toString()
