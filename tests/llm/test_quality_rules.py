import math
import random
import re
from collections import Counter, defaultdict

from framespan.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    rest, classes = text, []
    for pattern in q.CLASSES:
        classes.append(sum(map(len, re.findall(pattern, rest))))
        rest = re.sub(pattern, "", rest)
    common = Counter(w.lower() for w in words)
    each = [common[w] for w in q._WORDS]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), [*classes, len(rest)], [*each, len(words) - sum(each)]


def distance(a, b):
    sa, sb, total = max(sum(a), 1), max(sum(b), 1), 0
    for x, y in zip(a, b):
        x, y = x / sa, y / sb
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(max(0, total))


def brute(rows):
    got = [(d, lang, measure(t)) for d, lang, t in rows]
    failed = [m[0] < 20 or 100 * m[4] > 30 * m[0] for _, _, m in got]
    fits = [True] * len(rows)
    for _ in range(2):
        words, sums = Counter(), {}
        for (_, lang, m), bad, ok in zip(got, failed, fits):
            if lang is not None and not bad and ok:
                words[lang] += m[0]
                old = sums.get(lang, ([0] * 7, [0] * len(m[6])))
                sums[lang] = ([a + b for a, b in zip(old[0], m[5])], [a + b for a, b in zip(old[1], m[6])])
        for k, (_, lang, m) in enumerate(got):
            ref = sums[lang] if words[lang] >= q.MIN_REFERENCE_WORDS else None
            dc = distance(m[5], ref[0]) if ref and sum(m[5]) >= q.MIN_CHARS_FOR_CLASSES else 0
            dw = distance(m[6], ref[1]) if ref and m[0] >= q.MIN_WORDS_FOR_COMMON else 0
            fits[k] = dc <= q.MAX_CLASS_DISTANCE and dw <= q.MAX_COMMON_DISTANCE and not (dc > q.JOINT_CLASS_DISTANCE and dw > q.JOINT_COMMON_DISTANCE)
    return sorted(((d, *m[:5], bad, not bad and ok) for (d, _, m), bad, ok in zip(got, failed, fits)), key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted((tuple(r) for r in q.op2(docs).collect()), key=str) == brute(rows)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_edges(spark):
    rng = random.Random(1)
    rows = [(1, "en", None), (2, "en", ""), (3, None, "a b c " * 30), (4, "xx", "word\n" * 25), (4, "xx", "word\n" * 25), (None, "en", " \n\n x\n x\ny\n x"), (6, "en", "Ünï ✓ 😀 #1 **bold** 12 34\x0b5 <i>"), (7, "en", "\n".join(["the same line of this text is here again"] * 4 + ["another one"] * 3))]
    for d in range(40):
        words = [rng.choice("abcdef") for _ in range(rng.randint(5, 200))]
        rows.append((100 + d, "en", " ".join(words)))
    check(spark, rows)
    check(spark, [])


def test_good_texts_stay_and_most_junk_goes(spark):
    at = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{at}/documents.parquet").where("n_chars > 400")
    kept = defaultdict(list)
    for r in q.op2(docs.where(docs.doc_id.isin([*labels]))).collect():
        kept[labels[r["doc_id"]]].append(r["kept"])
    assert sum(kept[1]) > 0.99 * len(kept[1])
    assert sum(kept[0]) < 0.1 * len(kept[0])


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    rows = [(1, "en", " ".join(rng.choice(words) for _ in range(300_000))), (2, "en", "the same words again \n" * 40_000), (3, "en", "x" * 2_000_000)]
    check(spark, rows)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows[1:2]], "doc_id long, lang string, text string, w int, hw int, windows int")
    assert [tuple(r) for r in q.op2(docs).collect()] == brute(rows[1:2])
