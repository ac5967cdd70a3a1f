"""Quality rules on whole texts: repetition, and divergence from language references.

All of it is DataFrame functions. A text's histograms of character classes and of common
words are compared with those of its language, by Jensen-Shannon distance (base 2, 0 to 1).
The references are counted over all documents of a language that pass the base rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.llm.rolling import windows_of
from framespan.llm.storage import Workspace

MIN_WORDS, REPEAT_PERCENT, REPEAT_WORDS = 20, 30, 8
#: Texts with fewer characters or words than these are not judged by the histogram in question.
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_COMMON = 100, 60
#: A language is a reference from so many words on.
MIN_REFERENCE_WORDS = 2000
#: A text goes if one distance is over its limit, or both are over these lower limits.
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE = 0.3, 0.45
JOINT_CLASS_DISTANCE, JOINT_COMMON_DISTANCE = 0.16, 0.26
#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that for it on with as was at by this be are from an "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine auch es "
    "le la les et des en un du une est que dans qui par pour sur au il pas avec "
    "el los las una por con para se del al lo su más pero sus como sin"
).split()
#: Characters that are counted one class after another: each pattern sees what those before it left.
CLASSES = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"[\x21-\x7E]+")

_WORDS = sorted(set(COMMON_WORDS))


def _repeated_words() -> Column:
    """Words in windows of 8 words that stand twice or more in the array ``w``; ``windows`` has their hashes."""
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))[0]
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.transform(F.array(starts), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get(p, i + 1) - x, F.lit(REPEAT_WORDS)))), F.lit(0), lambda a, x: a + x))[0]
    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common.

    ``classes`` has the characters of each class and the rest, ``common`` the counts of each
    common word and of all other words. Null texts count as empty.
    """
    text = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t0"))
    for k, pattern in enumerate(CLASSES):
        kept = [f"c{j}" for j in range(k)]
        text = text.select("doc_id", "lang", *(["t0"] if k else []), *kept, F.col(f"t{k}"), F.regexp_replace(f"t{k}", pattern, "").alias(f"t{k + 1}"))
        text = text.select("doc_id", "lang", "t0", *kept, (F.length(f"t{k}") - F.length(f"t{k + 1}")).cast("long").alias(f"c{k}"), f"t{k + 1}")
    counts = [f"c{k}" for k in range(len(CLASSES))]
    text = text.select("doc_id", "lang", "t0", *counts, F.length(f"t{len(CLASSES)}").cast("long").alias("rest"), F.filter(F.split("t0", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    lines = F.filter(F.split("t0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    text = text.select("doc_id", "lang", *counts, "rest", F.size("w").cast("long").alias("n_words"), F.length("t0").cast("long").alias("chars"), lines.alias("lines"),
                       F.transform("w", lambda x: F.xxhash64(x)).alias("hw"),
                       F.lower(F.concat(F.lit("  "), F.array_join(F.filter("w", lambda x: F.lower(x).isin(_WORDS)), "  "), F.lit("  "))).alias("found"))
    text = text.withColumn("windows", windows_of("hw", REPEAT_WORDS))
    size = F.length("found")
    each = [((size - F.length(F.replace("found", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in _WORDS]
    text = text.withColumn("each", F.array(*each))
    return text.select(
        "doc_id", "lang", "n_words",
        (F.col("chars") - F.col("c1")).alias("word_chars"),
        F.col("c4").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words().alias("n_repeat_words"),
        F.array(*counts, "rest").alias("classes"),
        F.concat("each", F.array(F.col("n_words") - F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x))).alias("common"),
    )


def _summed(column: str, size: int) -> list[Column]:
    return [F.sum(F.col(column)[k]).alias(f"{column}_{k}") for k in range(size)]


def _distance(own: str, reference: str, size: int) -> Column:
    """Jensen-Shannon distance of two histograms of counts (arrays)."""

    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x.cast("double"))

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def divergence(p, q):
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    shares = F.transform(F.array(F.struct(F.greatest(total(own), F.lit(1.0)).alias("a"), F.greatest(total(reference), F.lit(1.0)).alias("b"))), lambda s: F.zip_with(own, reference, lambda x, y: divergence(x / s["a"], y / s["b"])))[0]
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def judge(docs: DataFrame) -> DataFrame:
    """``measures`` with base_failed, class_distance, common_distance and kept.

    A distance is null, and does not count against a text, where the text is too short, its
    language is null or has no reference. An empty table gives no rows; repeated rows are
    judged alike.
    """
    work = Workspace(docs.sparkSession, "quality-rules")
    n_classes, n_common = len(CLASSES) + 1, len(_WORDS) + 1
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    own = work.write(measures(docs).withColumn("base_failed", failed), "measures")
    trusted = own.where("not base_failed and lang is not null")
    for k in range(2):  # the second references leave out what is far from the first
        sums = trusted.groupBy("lang").agg(F.sum("n_words").alias("words"), *_summed("classes", n_classes), *_summed("common", n_common))
        reference = sums.where(F.col("words") >= MIN_REFERENCE_WORDS).select(
            "lang", F.array(*(f"classes_{j}" for j in range(n_classes))).alias("ref_classes"), F.array(*(f"common_{j}" for j in range(n_common))).alias("ref_common")
        )
        joined = _compared(own.join(work.write(reference, f"references{k}"), "lang", "left"))
        trusted = joined.where("not base_failed and lang is not null").where(_fits())
    return joined.withColumn("kept", ~F.col("base_failed") & _fits()).drop("ref_classes", "ref_common")


def _compared(joined: DataFrame) -> DataFrame:
    n_classes, n_common = len(CLASSES) + 1, len(_WORDS) + 1
    chars = reduce(lambda a, b: a + b, [F.col("classes")[k] for k in range(n_classes)])
    by_class = F.when((chars >= MIN_CHARS_FOR_CLASSES) & F.col("ref_classes").isNotNull(), _distance("classes", "ref_classes", n_classes))
    by_common = F.when((F.col("n_words") >= MIN_WORDS_FOR_COMMON) & F.col("ref_common").isNotNull(), _distance("common", "ref_common", n_common))
    return joined.withColumn("class_distance", by_class).withColumn("common_distance", by_common)


def _fits() -> Column:
    """Whether neither distance, nor both together, speak against a text."""
    by_class, by_common = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("common_distance", F.lit(0.0))
    both = (by_class > JOINT_CLASS_DISTANCE) & (by_common > JOINT_COMMON_DISTANCE)
    return (by_class <= MAX_CLASS_DISTANCE) & (by_common <= MAX_COMMON_DISTANCE) & ~both


def op2(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    """``op2`` in DuckDB SQL; histograms are rows (rid, kind, bin, n) there."""
    t, counts = "t", []
    for k, pattern in enumerate(CLASSES):
        rest = f"regexp_replace({t}, '{pattern}', '', 'g')"
        counts.append(f"length({t}) - length({rest}) AS c{k}")
        t = rest
    counts.append(f"length({t}) AS c{len(CLASSES)}")
    words = ", ".join(f"('{w}')" for w in _WORDS)
    class_rows = " UNION ALL ".join(f"SELECT rid, 'class' AS kind, '{k}' AS bin, c{k} AS n FROM m" for k in range(len(CLASSES) + 1))

    def compared(k: int, trusted: str) -> str:
        return f""",
words{k} AS (SELECT lang FROM f JOIN {trusted} USING (rid) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE_WORDS}),
ref{k} AS (SELECT lang, kind, bin, CAST(sum(h.n) AS DOUBLE) AS n FROM hist h JOIN f USING (rid) JOIN {trusted} USING (rid) WHERE NOT base_failed AND lang IN (SELECT lang FROM words{k}) GROUP BY ALL),
sums{k} AS (SELECT lang, kind, sum(n) AS total FROM ref{k} GROUP BY ALL),
share{k} AS (SELECT rid, h.kind, h.n / greatest(o.total, 1) AS x, r.n / greatest(s.total, 1) AS y FROM hist h JOIN f USING (rid) JOIN own o USING (rid, kind) JOIN ref{k} r ON r.lang = f.lang AND r.kind = h.kind AND r.bin = h.bin JOIN sums{k} s ON s.lang = f.lang AND s.kind = h.kind),
dist{k} AS (SELECT rid, kind, sqrt(greatest(0, sum((CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2))) AS d FROM share{k} GROUP BY ALL),
pair{k} AS (SELECT f.rid, coalesce(CASE WHEN chars >= {MIN_CHARS_FOR_CLASSES} THEN a.d END, 0) AS dc, coalesce(CASE WHEN n_words >= {MIN_WORDS_FOR_COMMON} THEN b.d END, 0) AS dw
  FROM f LEFT JOIN dist{k} a ON a.rid = f.rid AND a.kind = 'class' LEFT JOIN dist{k} b ON b.rid = f.rid AND b.kind = 'common'),
fits{k} AS (SELECT rid FROM pair{k} WHERE dc <= {MAX_CLASS_DISTANCE} AND dw <= {MAX_COMMON_DISTANCE} AND NOT (dc > {JOINT_CLASS_DISTANCE} AND dw > {JOINT_COMMON_DISTANCE}))"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT rid, {", ".join(counts)} FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + {REPEAT_WORDS - 1}], ' ') AS s FROM e, unnest(generate_series(1, len(w) - {REPEAT_WORDS - 1})) AS g(i) WHERE len(w) >= {REPEAT_WORDS}),
twice AS (SELECT rid, s FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + {REPEAT_WORDS - 1})) AS p FROM win JOIN twice USING (rid, s)) GROUP BY rid),
f AS (SELECT e.rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(t) - c1 AS word_chars, c4 AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(w) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {REPEAT_PERCENT} * len(w) AS base_failed, length(t) AS chars FROM e JOIN m USING (rid) LEFT JOIN rep USING (rid)),
list(bin) AS (VALUES {words}),
found AS (SELECT rid, bin, count(*) AS n FROM (SELECT rid, lower(unnest(w)) AS bin FROM e) JOIN list USING (bin) GROUP BY ALL),
grid AS (SELECT rid, bin, coalesce(n, 0) AS n FROM (SELECT rid, bin FROM d, list) LEFT JOIN found USING (rid, bin)),
hist AS ({class_rows} UNION ALL SELECT rid, 'common', bin, n FROM grid UNION ALL SELECT f.rid, 'common', ' ', n_words - coalesce(s, 0) FROM f LEFT JOIN (SELECT rid, sum(n) AS s FROM grid GROUP BY rid) USING (rid)),
own AS (SELECT rid, kind, sum(n) AS total FROM hist GROUP BY ALL),
everyone AS (SELECT rid FROM d){compared(1, "everyone")}{compared(2, "fits1")}
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND rid IN (SELECT rid FROM fits2) AS kept FROM f
"""
