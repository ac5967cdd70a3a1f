import hashlib
from collections import defaultdict
from urllib.parse import urlparse

import duckdb
import zstandard
from pyspark.sql.functions import spark_partition_id

from framespan.llm import storage, warc
from framespan.llm.storage import Workspace

NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows):
    raw = [(i, (h or "").encode()) for i, h in rows]
    keeper = defaultdict(list)
    for i, p in raw:
        if len(p) >= 1000 and i is not None:
            keeper[p].append(i)
    out = []
    for i, p in raw:
        most = max(keeper[p], default=None) if len(p) >= 1000 else None
        again = most is not None and i is not None and i < most
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", most if again else None))
    return sorted(out, key=str)


def check(spark, rows):
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nä", h, "n") for i, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert sorted((tuple(r) for r in warc.op6(pages).select(NAMES).collect()), key=str) == brute(rows)
    return pages


def test_copies_nulls_and_edges(spark):
    big, small = "<p>" + "ä" * 1500, "x" * 999
    rows = [(1, big), (2, big), (3, big), (3, big), (4, small), (5, small), (6, None), (7, ""), (None, big), (8, "y" * 1000), (9, "y" * 1000), (10, "z\r\n\r\n" * 400), (11, "w" * 3_000_000), (None, None)]
    pages = check(spark, rows)
    check(spark, [])
    work = Workspace(spark, "test-warc")
    index = warc.write_bundles(pages, work).collect()
    assert len(index) == len(rows)
    for r in index:  # each record is found by its frame and offset alone, and any reader of Zstandard can read the whole bundle
        with open(urlparse(r["bundle"]).path, "rb") as f:
            whole = f.read()
        import pyarrow as pa

        table = warc.seek_table(pa.BufferReader(whole))
        at, packed, content = table[r["frame"]]
        frame = zstandard.ZstdDecompressor().decompress(whole[at : at + packed], max_output_size=content)
        record = frame[r["offset"] : r["offset"] + r["length"]]
        (_, headers, _, _), *more = warc.parse_records(record)
        assert not more and headers["WARC-Record-ID"] == f"<urn:page:{'null' if r['page_id'] is None else r['page_id']}>"
        plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
        assert len(plain) == sum(c for _, _, c in table)


def test_real_rows_and_sql(spark):
    at = "/root/testdata/sf0.01/pages.parquet"
    got = sorted((tuple(r) for r in warc.op6(spark.read.parquet(at)).select(NAMES).collect()), key=str)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}'")
        assert sorted(db.sql(warc.ORACLE_SQL).fetchall(), key=str) == got


def test_many_frames(spark):
    check(spark, [(k, f"{k} " * 40_000) for k in range(60)])


def test_records_by_page(spark):
    big = "<p>" + "é" * 2000
    rows = [(1, big), (2, big), (3, "small"), (3, "other"), (None, "none"), *((k, f"{k} " * 30_000) for k in range(10, 40))]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    index = warc.write_bundles(pages, Workspace(spark, "test-warc"))
    for i in (1, 2, None, 10, 39):
        ((headers, _, payload),) = warc.read_record(index, i)
        assert payload.decode() == dict(rows)[i] and headers["WARC-Record-ID"] == f"<urn:page:{'null' if i is None else i}>"
    assert sorted(p.decode() for _, _, p in warc.read_record(index, 3)) == ["other", "small"]
    assert warc.read_record(index, 1)[0][0]["WARC-Type"] == "revisit" and warc.read_record(index, 99) == []


def test_reading_is_spread_over_tasks(spark, monkeypatch):
    """Descriptors of frames are a few small rows; still they are read by several tasks, and payloads are not shuffled."""
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 20)
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"{k} " * 40_000) for k in range(80)], "page_id long, url string, html string")
    read = warc.read_bundles(warc.write_bundles(pages, Workspace(spark, "test-warc")))
    used = read.withColumn("task", spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in used) == 80 and len(used) >= 8


def test_digests_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(storage, "HOT_ROWS", 3)
    big = "<p>" + "ä" * 1500
    check(spark, [*((k, big) for k in range(20)), *((100 + k, f"{k % 7}" * 2000) for k in range(30)), (None, big), (3, big), (200, "small")])
