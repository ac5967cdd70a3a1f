import zlib

import numpy as np

from framespan.llm.boosting import fit
from framespan.llm.quality_model import FEATURES, keep_good, op4, statistics


def walk(model, x):
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + (x[f[at]] > t[at])
        total += v[at - len(f)]
    return 1 / (1 + np.exp(-total))


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:1500], y[:1500], trees=40)
    p = model.probability(x[1500:])
    assert ((p >= 0.5) == y[1500:]).mean() > 0.95
    assert np.allclose(p[:50], [walk(model, r) for r in x[1500:1550]])
    assert np.allclose(fit(x[:0], y[:0]).probability(x[:3]), 0.5)
    assert len(set(fit(x[:50], np.ones(50)).probability(x[:9]))) == 1


def test_statistics_of_long_and_empty_texts():
    assert statistics(b"") == [0.0] * len(FEATURES)
    assert len(statistics(b"\xc3\xa9 " * 2_000_000)) == len(FEATURES) and np.isfinite(statistics(b"x" * 3_000_000)).all()


def test_long_texts_are_counted_as_a_whole():
    """Pieces change nothing: words and lines that return in another piece count as seen, what lies on an edge is whole."""
    rng = np.random.default_rng(5)
    words = [f"w{k}".encode() for k in range(5000)]
    ends = [b" ", b"\n", b"\n\n", b"  ", b"\r\n"]
    text = b"".join(words[i] + ends[j] for i, j in zip(rng.integers(0, 5000, 600_000), rng.choice(5, 600_000, p=[0.8, 0.1, 0.04, 0.03, 0.03])))
    for own in (text, b"one line " * 400_000, b"x" * 2_500_000, b"ab\n" * 900_000):
        got, name = dict(zip(FEATURES, statistics(own))), own.split()
        lines = [x for x in own.split(b"\n") if x]
        assert got["distinct_words"] == len(set(name)) / len(name) and got["same_as_before"] == sum(a == b for a, b in zip(name, name[1:])) / len(name)
        assert got["repeated_lines"] == (len(lines) - len(set(lines))) / len(lines) and got["line_words"] == len(name) / len(lines) and got["longest_word"] == max(map(len, name))


def test_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = op4(docs, labels).collect()
    assert len(got) == docs.count()
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in quality:
            right.append(r["predicted"] == quality[r["doc_id"]])
    assert len(right) > 1000 and np.mean(right) > 0.98


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some good text here", "y"), (3, "some good text here", "y"), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 1, None), (None, 1, 1), (4, None, 0)], none.schema)
    for labels in (none, some):
        assert op4(docs, labels).count() == 5 and op4(docs.limit(0), labels).count() == 0
        assert keep_good(docs, labels).columns == docs.columns
