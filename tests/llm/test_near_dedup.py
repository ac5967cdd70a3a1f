import random
import re
from collections import defaultdict

from framespan.llm import storage
from framespan.llm.near_dedup import keep_one_of_each, op7

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sets_of(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for x in s:
            for j in holds[x]:
                if j < i:
                    seen[j] += 1
        for j, o in seen.items():
            if 100 * o >= 85 * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, source string, n long")
    got = sorted((tuple(r) for r in op7(docs).collect()), key=str)
    assert got == brute(rows)
    return docs


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_edges_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three four five"), (6, "one two three four five"), (7, "ONE two three four five"), (8, "Ä b c d e"), (9, "ä b c d e"), (None, "one two three four five")]
    rows = rows[:-1]
    docs = check(spark, rows)
    kept = sorted(r[0] for r in keep_one_of_each(docs).collect())
    assert kept == [1, 2, 3, 4, 6, 8, 9]
    check(spark, [])


def test_family_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for d in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
        rows.append((d, " ".join(words)))
    docs = check(spark, rows)
    want = sum(r[3] for r in brute(rows))
    assert keep_one_of_each(docs).count() == want


def test_very_long_text(spark):
    long = " ".join(f"a{k % 70000}" for k in range(600_000))
    check(spark, [(1, long), (2, long + " tail"), (3, "short text of no more than a few words")])


def test_components_whose_ids_are_null_or_repeat(spark):
    near = [f"w{k}" for k in range(100)]
    rows = [(1, None), (None, ""), (6, "one two three four five"), (6, "one two three four five"), (None, "one two three four five"), (None, "quite another text of words"), (None, "quite another text of words")]
    rows += [(8, "this has the id of the next"), (8, "and that is not like it"), (None, " ".join(near)), (9, " ".join(near + ["tail"])), (None, "a third text without an id")]
    docs = check(spark, rows)
    kept = sorted((tuple(r)[:2] for r in keep_one_of_each(docs).collect()), key=str)
    want = [rows[0], rows[1], rows[2], rows[5], rows[7], rows[8], rows[10], rows[11]]
    assert kept == sorted(want, key=str)


def exact_links(sets):
    """All pairs of similarity 0.85 or more: those that share one of their rarest shingles, as any such pair must, compared in full."""
    df = defaultdict(int)
    for s in sets:
        for x in s:
            df[x] += 1
    holds, out = defaultdict(list), []
    for i, s in enumerate(sets):
        first = sorted(s, key=lambda x: (df[x], x))[: len(s) - (85 * len(s) + 99) // 100 + 1]
        for j in {j for x in first for j in holds[x]}:
            o = len(s & sets[j])
            if 100 * o >= 85 * (len(s) + len(sets[j]) - o):
                out.append((i, j))
        for x in first:
            holds[x].append(i)
    return out


def test_recall_on_ten_thousand_documents(spark):
    """Links between different texts of sf0.1 and changed copies of 2000 of them are within a component, and nothing else is joined."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows, rng = sorted(tuple(r) for r in docs.collect()), random.Random(8)
    for d, text in [r for r in rows if r[1] and len(r[1].split()) > 80][:2000]:
        words = text.split()
        for k in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.015])))):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
        rows.append((10**6 + d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    kinds: dict[frozenset, int] = {}
    own = [kinds.setdefault(frozenset(map(hash, sets_of(t))), len(kinds)) for _, t in rows]
    sets = list(kinds)
    links = exact_links(sets)
    component = defaultdict(set)
    for r, k in zip(rows, own):
        component[k].add(r[0])
    found = {r["doc_id"]: r["component_id"] for r in op7(docs).collect()}
    at = [found[min(component[k])] for k in range(len(sets))]
    together = sum(at[i] == at[j] for i, j in links)
    print(f"recall of links between different sets: {together} of {len(links)}")
    assert len(links) > 1000 and together >= 0.999 * len(links)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for k in range(len(sets)):
        least[find(k)] = min(least[find(k)], min(component[k]))
    wrong = [k for k in range(len(sets)) if sets[k] and at[k] != least[find(k)]]
    assert len(wrong) <= 0.001 * len(sets)


def test_hot_keys_and_tables_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(storage, "HOT_ROWS", 20)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(d, " ".join(base)) for d in range(80)]
    for d in range(80, 160):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 8])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        rows.append((d, " ".join(words)))
    rows += [(None, "a text without an id of five words or more"), (200, None)]
    docs = check(spark, rows)
    want = sum(bool(r[3]) for r in brute(rows))
    assert keep_one_of_each(docs).count() == want
