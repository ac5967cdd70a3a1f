import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from framespan.llm import storage
from framespan.llm.decontam import ORACLE_SQL, keep_uncontaminated, op10

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else []:
            windows[tuple(w[k : k + 13])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, item_id string, w string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in op10(d, b).collect()), key=str) == want
    assert keep_uncontaminated(d, b).count() == sum(not r[5] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 13, 14, 30]))) for k in range(12)] + [(50, None), (51, " -- "), (52, text(20)), (53, "Solo")]
    items += [(54, items[4][1]), (None, items[5][1])]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            low = rng.randint(0, 3)
            parts += [" ".join(own[low : low + rng.randint(5, 40)]), text(rng.randint(0, 30))]
        docs.append((d, (" " + rng.choice([" ", ", ", "\n"])).join(parts).upper() if d % 3 else " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (103, docs[5][1]), (103, docs[5][1]), (None, docs[7][1]), (104, "solo"), (105, "É é É " + items[4][1] * 2)]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [])


def test_real_rows_and_sql(spark):
    at = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((tuple(r) for r in op10(docs, items).collect()), key=str) == want
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
        assert sorted(db.sql(ORACLE_SQL).fetchall(), key=str) == want


def test_long_texts_and_hot_ones(spark, monkeypatch):
    """A very long text full of occurrences, a text and a passage that a third of all rows hold, and nothing small enough to broadcast."""
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(storage, "HOT_ROWS", 15)
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    items = [(k, text(40)) for k in range(6)]
    long = " ".join(text(2000) + " " + items[k % 6][1] for k in range(60))
    docs = [(0, long), (1, long + " tail"), *((10 + k, items[0][1]) for k in range(50)), *((100 + k, text(30) + " " + items[1][1] + " " + text(5)) for k in range(50)), *((200 + k, text(60)) for k in range(50))]
    check(spark, docs, items)


def test_letters_that_full_lower_case_would_change(spark):
    """Only A-Z count as a-z; the Kelvin sign, dotted I and others are as they are written."""
    item = " ".join(["kelvin", "istanbul", "straße", "ünï"] * 4)
    docs = [(1, item.upper()), (2, item.replace("k", "\u212a")), (3, item.replace("i", "\u0130")), (4, item.replace("ü", "Ü")), (5, item.title().replace("Ü", "ü")), (6, item)]
    check(spark, docs, [(1, item), (2, "\u212aelvin \u0130")])
