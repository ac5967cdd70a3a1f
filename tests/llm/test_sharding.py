import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framespan.llm import sharding
from framespan.llm.sharding import op5, shard_by_bytes


def check(docs, slack=None):
    rows = docs.select("doc_id", "text").collect()
    got = op5(docs).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if rows:
        each, most = sum(sizes.values()) / 24, max(r["size"] for r in got)
        assert max(abs(sizes[k] - each) for k in range(24)) <= most + 0.002 * each
    return got


def test_real_rows(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_hot_copies_repeats_nulls_and_edges(spark):
    rows = [(d, "the same text " * 20, "x") for d in range(3000)] + [(7, "one row again and again " * 10, "y")] * 3000 + [(None, None, "z"), (None, "", "z"), (-(1 << 62), "a", "z"), (1 << 62, "ä" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_text string").repartition(5)
    got = check(docs)
    assert len({r["shard"] for r in got}) == 24
    check(docs.limit(0))
    check(docs.limit(1))
    assert shard_by_bytes(docs, 3, ("text", "p_text")).columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "p_text"]


def brute(rows, shards, pieces):
    """Rows (key, size, name) sorted, and the shards that each place may be in: of each target both neighbours of the row on it."""
    rows, below, total = sorted(rows), 0, sum(r[1] for r in rows)
    allowed = []
    slack = sharding.TOLERANCE * total / pieces
    for _, size, _ in rows:
        low, high = below - slack, below + size + slack
        allowed.append({k for k in range(shards) if (k == 0 or total * k / shards < high + size) and (k == shards - 1 or total * (k + 1) / shards > low - size)})
        below += size
    return rows, allowed


@pytest.mark.parametrize("small", [False, True])
def test_equals_sorting_all_rows(spark, monkeypatch, small):
    """Shards hold neighbours in the order of keys, cut at equal bytes, with slots in that order; also where pieces are divided further."""
    if small:
        monkeypatch.setattr(sharding, "PIECE_BYTES", 4096)
        monkeypatch.setattr(sharding, "PIECES", 48)
    texts = [("the same text " * 30, 700), ("ä" * 300, 1), ("", 40)]
    rows = [(k, None if k % 97 == 0 else k * k % 5000 - 2000, t) for t, n in texts for k in range(n)] + [(1000 + k, k, f"text {k} " * (k % 50)) for k in range(2000)]
    docs = spark.createDataFrame([(d, t, f"{n}-{k}") for k, (n, d, t) in enumerate(rows)], "doc_id long, text string, name string").repartition(6).cache()
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id")
    keys = docs.select("name", F.shiftrightunsigned(F.xxhash64(text), 4).alias("h"), F.coalesce(doc, F.lit(-(1 << 62))).alias("d"), (F.octet_length(text) + 8).alias("size")).collect()
    shards = 24
    pieces = 48 if small else shards
    order, allowed = brute([((r["h"], r["d"]), r["size"], r["name"]) for r in keys], shards, pieces)
    got = {r["name"]: (r["shard"], r["slot"]) for r in shard_by_bytes(docs, shards, ("name",)).collect()}
    assert len(got) == len(rows)
    by_key = defaultdict(list)
    for key, _, name in order:
        by_key[key].append(got[name])
    placed = [x for key in sorted(by_key) for x in sorted(by_key[key])]
    assert placed == sorted(placed)
    assert all(s in own for (s, _), own in zip(placed, allowed))
    numbers = Counter(s for s, _ in placed)
    assert placed == [(s, k) for s in sorted(numbers) for k in range(numbers[s])]


def test_very_long_text(spark):
    check(spark.createDataFrame([(1, "x" * 9_000_000), (2, "é" * 3_000_000), (3, "short"), (4, None)], "doc_id long, text string"))
