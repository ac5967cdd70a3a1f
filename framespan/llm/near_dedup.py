"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Two collections of ``SIDE`` small keys are made from ``2 * SIDE * WIDTH`` minhashes. A table
key joins one key of either collection, so ``SIDE ** 2`` tables of ``2 * WIDTH`` minhashes
each are had for the cost of ``2 * SIDE`` small ones. A pair of similarity J shares a table
key with probability ``(1 - (1 - J ** WIDTH) ** SIDE) ** 2``: 0.99975 at 0.85, 0.99998 at 0.9.

Documents with equal sets form one class. In a bucket of classes that share a table key,
members are first compared with one pivot; what is then in one component needs no further
comparison. Buckets that still hold several components are compared again with the pivot
that has most shingles in common with others, and at last pair by pair, but only pairs
whose sizes and numbers of shared shingles allow the threshold: shingles that only one
class in question has can be in no intersection. So a bucket of many distant copies costs
about its size, no pair that may reach the threshold is left out, and no bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.llm.components import connected_components
from framespan.llm.shingles import groups, mix, shingle_batch
from framespan.llm.storage import Workspace, all_of, hot_from, join_dealt, join_sized, unused
from framespan.llm.worker import ROWS, release, trim

SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 85
SIDE, WIDTH = 7, 2
#: Members of a bucket that one task compares with each other.
BLOCK = 2000

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 64, 2 * SIDE * WIDTH, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 64, 2 * SIDE * WIDTH, dtype=np.uint64) | np.uint64(1)


def _signatures(batches):
    release()
    for batch in (b.slice(low, 2 * ROWS) for b in batches for low in range(0, b.num_rows, 2 * ROWS)):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for low, high in groups(texts):
            hashes, number = shingle_batch(texts[low:high], SHINGLE_WORDS)
            begin = np.cumsum(number) - number
            some = np.flatnonzero(number)
            least = np.zeros((len(number), 2 * SIDE * WIDTH), np.uint64)
            if len(some):
                for k in range(2 * SIDE * WIDTH):
                    least[some, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _MULTIPLY[k], begin[some])
            small = least[:, 0::WIDTH].copy()
            for k in range(1, WIDTH):
                small = mix(small + least[:, k::WIDTH])
            sets = [np.unique(hashes[b : b + n]) for b, n in zip(begin, number)]
            keys = pa.array(list(small.view(np.int64)) if len(small) else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(low, high - low) for c in ("doc_id", "t1", "t2")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    keys,
                ],
                names=["doc_id", "t1", "t2", "n", "c", "keys"],
            )
    trim()


def _full_sets(batches):
    release()
    for batch in (b.slice(low, 2 * ROWS) for b in batches for low in range(0, b.num_rows, 2 * ROWS)):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for low, high in groups(texts):
            hashes, number = shingle_batch(texts[low:high], SHINGLE_WORDS)
            begin = np.cumsum(number) - number
            sets = [np.unique(hashes[b : b + n]).view(np.int64) for b, n in zip(begin, number)]
            yield pa.RecordBatch.from_arrays([batch.column("c").slice(low, high - low), pa.array(sets, pa.list_(pa.int64()))], names=["c", "s"])
    trim()


def _text_keys() -> list:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(17), F.col("text")).alias("t2")]


def _allowed(n1: str, n2: str, overlap, percent: int) -> F.Column:
    return F.lit(100) * overlap >= F.lit(percent) * (F.col(n1) + F.col(n2) - overlap)


def _first_table() -> F.Column:
    """The first table in which the small keys ``keys`` and ``keys2`` meet: so a pair is made once, not in every table."""

    def first(begin: int) -> F.Column:
        return F.array_position(F.zip_with(F.slice("keys", begin + 1, SIDE), F.slice("keys2", begin + 1, SIDE), lambda a, b: a == b), True) - 1

    return first(0) * SIDE + first(SIDE)


def _confirmed(work: Workspace, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    first = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    both = first.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    counted = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("o"))
    return work.write(counted.where(_allowed("na", "nb", F.col("o"), percent)).select("a", "b"), "links")


def _star(members: DataFrame, pivot: str) -> DataFrame:
    """Pairs (a, b) of the members of buckets and their pivots."""
    return members.where(F.col("c") != F.col(pivot)).select(F.least("c", pivot).alias("a"), F.greatest("c", pivot).alias("b")).distinct()


def _rooted(work: Workspace, members: DataFrame, roots: DataFrame, hot: DataFrame, most: int, label: str) -> DataFrame:
    """Members of buckets that still hold more than one component, with their roots and how many they are."""
    own = members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("left")).where("lo <> hi")
    return work.write(join_dealt(own, mixed.select("key", "left"), ["key"], hot, most), label)


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of ``percent`` (85) hundredths or more.

    Takes ``doc_id`` and ``text`` of ``docs`` (further columns, whatever their names, are ignored).
    Returns two tables: one row per input row with (doc_id, t1, t2, n, component_id, root), where
    (t1, t2) is a 128-bit key of the text, and the confirmed links between classes (a, b). A text
    without words, or null, has an empty set, its own ``doc_id`` as component and no root. Copies
    and repeated rows are one class. A component's id is the least ``doc_id`` that is not null,
    null if there is none; ids may repeat, so only ``root``, the least class, tells components apart.
    No rows give none.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = cast.select("doc_id", *_text_keys(), "text")
    rows = work.write(keyed.mapInArrow(_signatures, "doc_id long, t1 long, t2 long, n long, c binary, keys array<long>").withColumnRenamed("c", "same"), "rows")
    alike = rows.where("same is not null").groupBy("same").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("t1", "t2", F.col("doc_id").alias("d"))).alias("text_at"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies")
    )
    # Classes get short numbers, once and for all as they are written.
    classes = work.write(alike.withColumn("c", F.monotonically_increasing_id()), "classes")
    sizes = classes.select("c", "n")
    tables = F.array(*(F.xxhash64(F.lit(i * SIDE + j), F.col("keys")[i], F.col("keys")[SIDE + j]) for i in range(SIDE) for j in range(SIDE)))
    placed = classes.select("c", "n", F.explode(tables).alias("key"))
    shared_keys = placed.groupBy("key").agg(F.count("*").alias("copies"), F.min("c").alias("pivot")).where("copies > 1")
    buckets = work.write(shared_keys.join(sizes.select(F.col("c").alias("pivot"), F.col("n").alias("pn")), "pivot"), "buckets")
    most = hot_from(SIDE * SIDE * classes.count())
    hot = work.write(buckets.select("key", "copies").where(F.col("copies") > most), "hot")
    members = work.write(join_dealt(placed, buckets, ["key"], hot, most), "members")

    wanted = members.select("c").distinct().join(classes.select("c", "text_at"), "c").select("c", F.col("text_at.t1").alias("t1"), F.col("text_at.t2").alias("t2"), F.col("text_at.d").alias("doc_id"))
    # A null id matches a null id: its place is taken by whether it is null, and a number.
    known = lambda df: df.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    texts = join_sized(known(keyed), work.write(known(wanted), "wanted"), ["t1", "t2", "none", "doc_id"], 64)
    sets = work.write(texts.select("c", "text").mapInArrow(_full_sets, "c long, s array<long>").dropDuplicates(["c"]), "sets")

    near = F.lit(100) * F.least("n", "pn") >= F.lit(percent) * F.greatest("n", "pn")  # else no overlap is enough
    tried = work.write(_star(members.where(near), "pivot"), "tried")
    links = _confirmed(work, tried, sets, percent)
    roots = work.write(connected_components(work, links), "roots")

    # Buckets of three or more whose members are not yet all in one component.
    left = _rooted(work, members.where("copies > 2").select("key", "c"), roots, hot, most, "left")
    if left.limit(1).count():
        tokens = sets.join(left.select("c").distinct(), "c", "left_semi").select("c", F.explode("s").alias("t"))
        lone = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("c").alias("c")).where("df = 1").groupBy("c").agg(F.count("*").alias("lone"))
        shared = left.select("c").distinct().join(sizes, "c").join(lone, "c", "left").select("c", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"))
        shared = work.write(shared.where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n")), "shared")
        kept = work.write(left.select("key", "c").join(shared, "c"), "kept")
        best = kept.groupBy("key").agg(F.max(F.struct("shared", "c", "n")).alias("best"))
        again = join_dealt(kept, best, ["key"], hot, most).where(F.col("c") != F.col("best.c")).where(_allowed("n", "best.n", F.least("shared", "best.shared"), percent))
        again = again.select("c", F.col("best.c").alias("p"))
        second = work.write(_star(again, "p").join(tried, ["a", "b"], "left_anti"), "second")
        links = links.union(_confirmed(work, second, sets, percent))
        roots = work.write(connected_components(work, links), "roots")

        rest = work.write(_rooted(work, kept, roots, hot, most, "mixed").join(classes.select("c", "keys"), "c"), "rest")
        parts = F.ceil(F.col("left") / BLOCK).cast("int")
        own, all_parts = F.pmod(F.xxhash64("c"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
        x = rest.select("key", "c", "n", "shared", "root", "keys", own.alias("px"), all_parts.alias("py"))
        y = rest.select("key", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("shared").alias("shared2"), F.col("root").alias("root2"), F.col("keys").alias("keys2"), own.alias("py"), all_parts.alias("px"))
        met = x.join(y, ["key", "px", "py"]).where("c < c2 and root <> root2").where(_allowed("n", "n2", F.least("shared", "shared2"), percent))
        table = _first_table()
        once = F.xxhash64(table.cast("int"), F.get("keys", (table / SIDE).cast("int")), F.get("keys", (table % SIDE + SIDE).cast("int")))
        last = met.where(F.col("key") == once).select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct().join(tried.union(second), ["a", "b"], "left_anti")
        links = links.union(_confirmed(work, last, sets, percent))
        roots = work.write(connected_components(work, links), "roots")
        work.drop(shared, kept, second, rest)

    named = classes.select("same", "c", "doc_id", "copies").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = work.write(named.join(least, "root").select("same", "component_id", "root", "copies"), "component")
    empty = rows.where("same is null").select("doc_id", "t1", "t2", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    many = hot_from(rows.count())
    full = join_dealt(rows.where("same is not null").select("doc_id", "t1", "t2", "n", "same"), component.drop("copies"), ["same"], component.select("same", "copies").where(F.col("copies") > many), many)
    out = work.write(full.select("doc_id", "t1", "t2", "n", "component_id", "root").union(empty), "components")
    work.drop(rows, classes, buckets, hot, members, sets, tried, left, component)
    return out, links


def op7(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (``doc_id = component_id``)."""
    found, _ = near_duplicates(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, without near duplicates of a document that stays.

    Of each component the row with the least ``doc_id`` that is not null stays, of repeated such
    rows the least by the other columns; documents without words all stay.
    """
    found, _ = near_duplicates(docs, percent)
    work = Workspace(docs.sparkSession, "near-dedup")
    i, t1, t2, none = unused(docs.columns, "i", "t1", "t2", "none")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    best = found.where("n > 0").groupBy("root").agg(F.min(key).alias("k"), F.count("*").alias("copies"))
    best = work.write(best, "best")
    many = hot_from(found.count())
    hot = best.select("root", "copies").where(F.col("copies") > many)
    judged = work.write(join_dealt(found.where("n > 0"), best.select("root", "k"), ["root"], hot, many).select(key.alias("own"), (key == F.col("k")).alias("stays")), "judged")
    goes = judged.where("not stays").select(F.coalesce("own.doc_id", F.lit(0).cast("long")).alias(i), F.col("own.none").alias(none), F.col("own.t1").alias(t1), F.col("own.t2").alias(t2)).distinct()
    goes = work.write(goes, "goes")
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    marked = docs.select("*", F.coalesce(doc, F.lit(0).cast("long")).alias(i), doc.isNull().alias(none), F.xxhash64(text).alias(t1), F.xxhash64(F.lit(17), text).alias(t2))
    kept = join_sized(marked, goes, [i, none, t1, t2], 64, "left_anti")
    repeated = judged.where("stays").groupBy("own").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept.select(*all_of(kept, docs.columns))
    # Copies of a row that stays: the least of them, found before the shuffle as far as a task has several.
    blank = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    wordless = kept.where(blank).select(*all_of(kept, docs.columns))
    own = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    if len(own) < len(docs.columns):  # maps have no order: any copy stays
        return kept.where(~blank).dropDuplicates([i, none, t1, t2]).select(*all_of(kept, docs.columns)).union(wordless)
    order = sorted(own, key=lambda c: c in ("doc_id", "text"))  # by what may differ, not by the text
    (row,) = unused(kept.columns, "row")
    least = kept.where(~blank).groupBy(i, none, t1, t2).agg(F.min(F.struct(*all_of(kept, order))).alias(row))
    return least.select(*(F.col(row)[c].alias(c) for c in docs.columns)).union(wordless)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT r.a AS rid, min(w.doc_id) AS component_id FROM reach r JOIN w ON w.rid = r.b GROUP BY r.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w LEFT JOIN n USING (rid) JOIN least USING (rid)
"""
