"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of 13 consecutive words (one window if it has fewer), a window
into shingles of 5 words. Containment is asked for in full, so every shingle of a window is
necessary and the prefix of a window is one shingle: the rarest, by the number of windows
that have it, of those the one with most characters. Only prefixes are joined to the shingles
of the documents. The place found must leave room for the words before and after it in the
window (positional and length bounds), and then the words themselves are compared, window
by window, with those of the document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.llm.rolling import windows_of
from framespan.llm.storage import Workspace, all_of, join_sized, unused

WINDOW_WORDS, SHINGLE_WORDS = 13, 5
#: What is between words: all of ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: About how many bytes a row of what is joined takes: prefixes, occurrences of a text, measures of a text.
_PREFIX_BYTES, _LIST_BYTES, _MEASURE_BYTES = 120, 600, 250


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    """Words as they are written; only the first and the last part of a split can be empty."""
    return F.transform(F.array(F.split(text, _BETWEEN)), lambda w: F.slice(w, F.when(F.get(w, 0) == "", 2).otherwise(1), _number(w)))[0]


def _number(parts: Column) -> Column:
    n = F.size(parts)
    return n - F.when(F.get(parts, 0) == "", 1).otherwise(0) - F.when((n > 1) & (F.get(parts, n - 1) == ""), 1).otherwise(0)


def number_of_words(text: Column) -> Column:
    return F.transform(F.array(F.split(_text(text), _BETWEEN)), _number)[0].cast("long")


def words_of(text: Column) -> Column:
    """Words of digits, letters a-z and characters beyond ASCII; A-Z count as a-z, null has none."""
    return _words(F.translate(_text(text), string.ascii_uppercase, string.ascii_lowercase))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _text_keys(*names: str) -> list[Column]:
    return [F.xxhash64("text").alias(names[0]), F.xxhash64(F.lit(17), F.col("text")).alias(names[1])]


def _shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    """``df`` with a row (width, pos, h) for each shingle of the widths of the array ``hw``, places from 1."""
    kept = [c for c in df.columns if c != "hw"]
    if len(widths) == 1:
        return df.select(*kept, F.posexplode(windows_of("hw", widths[0])).alias("pos", "h")).select(*kept, F.lit(widths[0]).alias("width"), (F.col("pos") + 1).alias("pos"), "h")

    def rows(x: int) -> Column:
        return F.transform(windows_of("hw", x), lambda h, i: F.struct(F.lit(x).alias("width"), (i + 1).alias("pos"), h.alias("h")))

    return df.select(*kept, F.inline(F.concat(*map(rows, widths))))


def candidates(work: Workspace, docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Places (k1, k2, start, wid) where the prefix of a window stands in a text and the window fits; (k1, k2) is the key of a text.

    ``windows`` has (wid, w) of distinct windows.
    """
    # Full lower case makes more words equal than A-Z as a-z does, so it loses no place; and it is had much faster.
    folded = windows.select("wid", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("width"), F.transform("w", lambda x: F.lower(x)).alias("lw"))
    widths = sorted(r[0] for r in folded.select("width").distinct().collect())  # 1 to 5
    if not widths:
        return work.write(docs.select(*_text_keys("k1", "k2"), F.lit(0).alias("start"), F.lit("").alias("wid")).where("false"), "candidates")
    tokens = _shingles(folded.withColumnRenamed("width", "own").withColumn("hw", _hashes(F.col("lw"))), widths).where("width = own")
    chars = F.aggregate(F.slice("lw", F.col("pos"), F.col("width")), F.lit(0), lambda a, x: a + F.length(x))
    tokens = work.write(tokens.select("wid", "len", "width", F.col("pos").alias("at"), "h", chars.alias("chars")), "tokens")
    spread = tokens.groupBy("width", "h").agg(F.count_distinct("wid").alias("windows"))
    ranked = tokens.join(spread, ["width", "h"]).groupBy("wid", "len", "width").agg(F.min(F.struct("windows", -F.col("chars"), "h", "at")).alias("r"))
    prefix = work.write(ranked.select("width", F.col("r.h").alias("h"), "wid", "len", F.col("r.at").alias("at")), "prefix")

    split = docs.select(*_text_keys("k1", "k2"), _hashes(_words(F.lower(_text(F.col("text"))))).alias("hw"))
    places = _shingles(split.withColumn("n", F.size("hw")), widths)
    found = join_sized(places, prefix, ["width", "h"], _PREFIX_BYTES).withColumn("start", F.col("pos") - F.col("at") + 1)
    found = work.write(found.where("start >= 1 and start + len - 1 <= n").select("k1", "k2", "start", "wid").distinct(), "candidates")
    work.drop(tokens, prefix)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text with an occurrence: (k1, k2, n, n_hit, n_items, items_sha256), (k1, k2) a 128-bit key of the text, n its words.

    Null and empty texts have no words; items without words have no windows; an item whose
    id is null marks words as hit but is not listed. Only ``text`` of ``docs`` is read.
    """
    work = Workspace(docs.sparkSession, "decontam")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w"))
    begin = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW_WORDS - 1), F.lit(1)))
    cut = items.where(F.size("w") > 0).select("item_id", F.explode(F.transform(begin, lambda i: F.slice("w", i, WINDOW_WORDS))).alias("w"))
    owned = work.write(cut.select("item_id", F.sha2(F.array_join("w", " "), 256).alias("wid"), "w").distinct(), "windows")
    windows = work.write(owned.select("wid", "w").dropDuplicates(["wid"]), "distinct")
    found = candidates(work, docs, windows)

    # The windows that may stand in a text, and where; then their words against those of the text.
    wanted = join_sized(found, windows, ["wid"], _PREFIX_BYTES).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "wid", "w")).alias("may"))
    wanted = work.write(wanted, "wanted")
    texts = join_sized(docs.select(*_text_keys("k1", "k2"), "text"), wanted, ["k1", "k2"], _LIST_BYTES)
    texts = texts.select("k1", "k2", "may", words_of(F.col("text")).alias("own"))
    sure = F.array_sort(F.filter("may", lambda c: F.slice("own", c["start"], F.size(c["w"])) == c["w"]))
    texts = texts.select("k1", "k2", F.size("own").alias("n"), F.transform(sure, lambda c: F.struct(c["start"].alias("lo"), (c["start"] + F.size(c["w"])).alias("hi"), c["wid"].alias("wid"))).alias("sure"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    fresh = lambda a, c: F.struct(F.greatest(a["end"], c["hi"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), c["hi"] - F.greatest(c["lo"], a["end"]))).alias("hit"))
    hit = F.aggregate("sure", zero, fresh)["hit"]
    measured = texts.where(F.size("sure") > 0).select("k1", "k2", "n", hit.alias("n_hit"), F.array_distinct(F.transform("sure", lambda c: c["wid"])).alias("wids"))
    measured = work.write(measured.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("n_hit").alias("n_hit"), F.first("wids").alias("wids")), "measured")

    listed = join_sized(measured.select("k1", "k2", F.explode("wids").alias("wid")), owned, ["wid"], _PREFIX_BYTES).select("k1", "k2", F.col("item_id").cast("string").alias("item"))
    listed = listed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = measured.join(listed, ["k1", "k2"]).select("k1", "k2", "n", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = work.write(out, "contamination")
    work.drop(found, wanted, measured, windows, owned)
    return out


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; repeated rows are alike; further columns, whatever their names,
    are ignored; no documents give no rows, and without items nothing is hit.
    """
    counted = docs.select("doc_id", *_text_keys("k1", "k2"), number_of_words(F.col("text")).alias("n_words"))
    joined = join_sized(counted, contamination(docs, benchmark).drop("n"), ["k1", "k2"], _MEASURE_BYTES, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (a twentieth of their words hit, or more), with all columns, whatever their names, as they are."""
    k1, k2 = unused(docs.columns, "k1", "k2")
    keyed = docs.select("*", *_text_keys(k1, k2))
    work = Workspace(docs.sparkSession, "decontam")
    bad = work.write(contamination(docs, benchmark).where("n_hit * 20 >= n").select(F.col("k1").alias(k1), F.col("k2").alias(k2)), "bad")
    kept = join_sized(keyed, bad, [k1, k2], 48, "left_anti")
    return kept.select(*all_of(kept, docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + 12], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s(i) WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM d, ls, unnest(generate_series(1, len(w) - l + 1)) AS s(i) WHERE len(w) >= l),
occ AS (SELECT dw.rid, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + l - 1)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, coalesce(its.sha, sha256('')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
