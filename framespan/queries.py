"""The registered queries, each with the DuckDB SQL that gives the same rows; more of them in ``queries_more``."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions import columns as C
from framespan.functions.values import threshold
from framespan.operators import masks, mixing, planner, segments, series, timeline, transitions
from framespan.plans import edit_language as lang
from framespan.registry import ORACLES, QUERIES, query, table
from framespan.sources import adapters as A

NTSC = Fraction(30000, 1001)
THRESHOLD = 0.2

# Shared parts of the SQL.
_LEVELS = """
WITH b AS (SELECT event_type AS src, CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS INT) AS frame, max(value) AS top, count(*) AS n FROM events GROUP BY 1, 2),
spine AS (SELECT src, CAST(unnest(generate_series(0, mf)) AS INT) AS frame FROM (SELECT src, max(frame) AS mf FROM b GROUP BY 1)),
levels AS (SELECT s.src, s.frame,
  CAST(trunc(CAST(least(coalesce(top, 0) / 500, 1) AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT) AS u16,
  CAST(trunc(CAST(least(coalesce(n, 0) / 20, 1) AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT) AS u16_count
  FROM spine s LEFT JOIN b USING (src, frame)),
loud AS (SELECT src, frame, u16 >= 13107 AS "on" FROM levels),
busy AS (SELECT src, frame, u16_count >= 9830 AS "on" FROM levels WHERE frame < 600)
"""


def _margin_sql(start: int, end: int) -> str:
    """Margin over ``loud``, as the CTE ``margin``."""
    rules = ""
    if start > 0:
        rules = f"WHEN coalesce(bool_or(s) OVER (PARTITION BY src ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND {start} FOLLOWING), false) THEN true" + rules
    elif start < 0:
        rules = f"WHEN coalesce(bool_or(s) OVER (PARTITION BY src ORDER BY frame ROWS BETWEEN {-start - 1} PRECEDING AND CURRENT ROW), false) THEN false" + rules
    if end > 0:
        rules = f"WHEN coalesce(bool_or(e) OVER (PARTITION BY src ORDER BY frame ROWS BETWEEN {end - 1} PRECEDING AND CURRENT ROW), false) THEN true " + rules
    elif end < 0:
        rules = f"WHEN coalesce(bool_or(e) OVER (PARTITION BY src ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND {-end} FOLLOWING), false) THEN false " + rules
    return f""",
edges AS (SELECT src, frame, "on", coalesce("on" AND NOT was, false) AS s, coalesce(NOT "on" AND was, false) AS e
  FROM (SELECT *, lag("on") OVER (PARTITION BY src ORDER BY frame) AS was FROM loud)),
margin AS (SELECT src, frame, CASE {rules} ELSE "on" END AS "on" FROM edges)"""


def _runs_sql(name: str, value: str, out: str) -> str:
    return f""",
{out} AS (SELECT src, CAST(min(frame) AS BIGINT) AS "start", CAST(max(frame) + 1 AS BIGINT) AS "end", any_value({value}) AS {value} FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY frame) AS run FROM (
    SELECT *, CASE WHEN {value} IS NOT DISTINCT FROM lag({value}) OVER (PARTITION BY src ORDER BY frame) AND lag(frame) OVER (PARTITION BY src ORDER BY frame) IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM {name}))
  GROUP BY src, run)"""


def _smooth_sql(min_cut: int, min_clip: int) -> str:
    """Smoothing of ``chunks`` (src, start, end, on), as the CTE ``smoothed``: iteration over lists of runs."""
    flipped = f"""list_transform(a, lambda x: CASE WHEN x.v AND x.l < {min_clip} THEN {{'v': false, 'l': x.l}} WHEN NOT x.v AND x.l < {min_cut} THEN {{'v': true, 'l': x.l}} ELSE x END)"""
    step = f"""list_reduce(list_transform({flipped}, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1].v = x[1].v THEN list_concat(acc[:len(acc) - 1], [{{'v': acc[-1].v, 'l': acc[-1].l + x[1].l}}]) ELSE list_concat(acc, x) END)"""
    return f""",
seed AS (SELECT src, list({{'v': "on", 'l': "end" - "start"}} ORDER BY "start") AS a FROM chunks GROUP BY src),
iter AS (SELECT src, 0 AS n, a, CAST(NULL AS STRUCT(v BOOLEAN, l BIGINT)[]) AS p, CAST(NULL AS STRUCT(v BOOLEAN, l BIGINT)[]) AS pp FROM seed
  UNION ALL SELECT src, n + 1, {step}, a, p FROM iter WHERE NOT coalesce(p = a, false) AND NOT coalesce(pp = a, false)),
done AS (SELECT src, arg_max(a, n) AS a FROM iter GROUP BY src),
smoothed AS (SELECT src, CAST(list_sum(list_transform(a[:i - 1], lambda x: x.l)) AS BIGINT) AS s0, a[i].l AS l, a[i].v AS "on"
  FROM done, unnest(generate_series(1, len(a))) AS g(i)),
smooth AS (SELECT src, coalesce(s0, 0) AS "start", coalesce(s0, 0) + l AS "end", "on" FROM smoothed)"""


def _levels(spark, sf_dir) -> DataFrame:
    return A.event_levels(table(spark, sf_dir, "events"))


def _loud(spark, sf_dir) -> DataFrame:
    return masks.above(_levels(spark, sf_dir), THRESHOLD)


#: Nullable masks over the table of levels: the highest value, and the number of events over the first 600 frames.
def _loud_column():
    return masks.col_above(F.col("u16"), THRESHOLD)


def _busy_column():
    return masks.col_above(F.when(F.col("frame") < 600, F.col("u16_count")), 0.15)


@query(_LEVELS + "SELECT src, frame, u16, u16_count FROM levels")
def q_levels_peak(spark, sf_dir):
    return _levels(spark, sf_dir)


@query("""
WITH s AS (SELECT event_type AS src, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)
SELECT src, CAST(idx // 256 * 256 AS BIGINT) AS bucket_start, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi FROM s GROUP BY ALL""")
def q_waveform_minmax(spark, sf_dir):
    return series.waveform(A.event_samples(table(spark, sf_dir, "events")), 256)


@query("""
WITH s AS (SELECT event_type AS src, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)
SELECT src, CAST(idx // 256 * 256 AS BIGINT) AS bucket_start, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi FROM s
WHERE idx // 256 * 256 + 256 > 300 AND idx // 256 * 256 < 900 GROUP BY ALL""")
def q_waveform_window(spark, sf_dir):
    return series.waveform(A.event_samples(table(spark, sf_dir, "events")), 256, window=(300, 900))


@query("""
WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT CAST(k AS BIGINT) AS k, CAST((2 * k * 48000 * 1001 + 30000) // 60000 AS BIGINT) AS first_sample, CAST(k * 48000 * 1001 // 30000 AS BIGINT) AS span_start, CAST((k + 7) * 48000 * 1001 // 30000 AS BIGINT) AS span_end FROM k""")
def q_bucket_boundary(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("k")).distinct()
    low, high = C.sample_span(F.col("k"), F.lit(7), 48000, NTSC)
    return k.select("k", C.bucket_start(F.col("k"), 48000, NTSC).alias("first_sample"), low.alias("span_start"), high.alias("span_end"))


@query("""
WITH s AS (SELECT event_type AS src, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events),
b AS (SELECT k, (2 * k * 1000 * 1001 + 30000) // 60000 AS lo, (2 * (k + 1) * 1000 * 1001 + 30000) // 60000 AS hi FROM generate_series(0, (SELECT max(idx) // 30 FROM s)) AS g(k))
SELECT src, CAST(k AS BIGINT) AS frame, CAST(trunc(CAST(least(max(abs(v)) / 500, 1) AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT) AS u16
FROM s JOIN b ON idx >= lo AND idx < hi GROUP BY src, k""")
def q_loudness(spark, sf_dir):
    return series.loudness(A.event_samples(table(spark, sf_dir, "events")), 1000, NTSC, full=500.0)


_CLIPS = """
WITH n AS (SELECT l_orderkey AS src, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, CAST(l_quantity AS BIGINT) AS dur FROM lineitem),
c AS (SELECT src, ord, dur, CAST(coalesce(sum(dur) OVER w, 0) AS BIGINT) AS "start", CAST(coalesce(sum(dur) OVER w, 0) + coalesce(sum(1 - ord % 2) OVER w, 0) AS BIGINT) AS "offset"
  FROM n WINDOW w AS (PARTITION BY src ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def _clips(spark, sf_dir) -> DataFrame:
    return A.order_clips(table(spark, sf_dir, "lineitem"))


@query(_CLIPS + 'SELECT src, ord, "start", dur, "offset" FROM c')
def q_order_clips(spark, sf_dir):
    return _clips(spark, sf_dir)


@query(_CLIPS + 'SELECT src, max("start" + dur) AS length FROM c GROUP BY src')
def q_media_length(spark, sf_dir):
    return series.media_length(_clips(spark, sf_dir).select("src", F.col("start").alias("pts"), "dur"))


@query(_LEVELS + 'SELECT src, frame, "on" FROM loud')
def q_threshold_mask(spark, sf_dir):
    return _loud(spark, sf_dir)


@query(_LEVELS + 'SELECT src, frame, coalesce(a."on", false) OR coalesce(b."on", false) AS "on" FROM loud a FULL JOIN busy b USING (src, frame)')
def q_mask_or(spark, sf_dir):
    return masks.as_mask(_levels(spark, sf_dir), masks.col_or(_loud_column(), _busy_column()))


@query(_LEVELS + 'SELECT src, frame, a."on" AND b."on" AS "on" FROM loud a JOIN busy b USING (src, frame)')
def q_mask_and(spark, sf_dir):
    return masks.as_mask(_levels(spark, sf_dir), masks.col_and(_loud_column(), _busy_column()))


@query(_LEVELS + 'SELECT src, frame, coalesce(a."on", false) <> coalesce(b."on", false) AS "on" FROM loud a FULL JOIN busy b USING (src, frame)')
def q_mask_xor(spark, sf_dir):
    return masks.as_mask(_levels(spark, sf_dir), masks.col_xor(_loud_column(), _busy_column()))


@query(_LEVELS + 'SELECT src, frame, NOT "on" AS "on" FROM loud')
def q_mask_not(spark, sf_dir):
    return masks.as_mask(_levels(spark, sf_dir), ~_loud_column())


@query(_LEVELS + """, m1 AS (SELECT src, frame, "on" FROM loud), m2 AS (SELECT src, frame, "on" FROM busy)
SELECT src, frame, coalesce(a."on", false) OR coalesce(b."on", false) AS "on" FROM m1 a FULL JOIN m2 b USING (src, frame)""")
def q_mask_tables(spark, sf_dir):
    """``or`` of masks that come as tables of their own lengths."""
    levels = _levels(spark, sf_dir)
    return masks.any_of([masks.as_mask(levels, _loud_column()), masks.as_mask(levels, _busy_column())])


@query(_LEVELS + "SELECT src, frame, true AS \"on\" FROM spine UNION ALL SELECT src, frame, false FROM spine WHERE false")
def q_mask_constants(spark, sf_dir):
    lengths = _levels(spark, sf_dir).groupBy("src").agg((F.max("frame") + 1).alias("length"))
    return masks.everything(lengths).union(masks.nothing(lengths))


@query(_LEVELS + 'SELECT src, frame, CASE WHEN coalesce(b."on", false) THEN 2 WHEN a."on" THEN 1 ELSE 0 END AS label FROM loud a FULL JOIN busy b USING (src, frame)')
def q_label_max(spark, sf_dir):
    return masks.as_mask(_levels(spark, sf_dir), masks.col_label([(1, _loud_column()), (2, _busy_column())]), "label")


@query(_LEVELS + _margin_sql(1, 1) + """, labels AS (SELECT src, frame, CASE WHEN coalesce(b."on", false) AND a."on" THEN 2 WHEN a."on" THEN 1 ELSE 0 END AS label FROM loud a LEFT JOIN busy b USING (src, frame))
SELECT src, frame, CASE WHEN NOT m."on" THEN 0 WHEN label = 0 THEN 1 ELSE label END AS label FROM labels JOIN margin m USING (src, frame)""")
def q_label_fold_back(spark, sf_dir):
    loud = _loud_column()
    labels = masks.as_mask(_levels(spark, sf_dir), masks.col_label([(1, loud), (2, masks.col_and(loud, _busy_column()))]), "label")
    active = segments.margin(labels.select("src", "frame", (F.col("label") != 0).alias("on"), "label"), 1, 1, keep=("label",))
    return active.select("src", "frame", F.when(~F.col("on"), 0).when(F.col("label") == 0, 1).otherwise(F.col("label")).alias("label"))


@query(_LEVELS + _margin_sql(2, 3) + 'SELECT src, frame, "on" FROM margin')
def q_margin_pos(spark, sf_dir):
    return segments.margin(_loud(spark, sf_dir), 2, 3)


@query(_LEVELS + _margin_sql(-1, -2) + 'SELECT src, frame, "on" FROM margin')
def q_margin_neg(spark, sf_dir):
    return segments.margin(_loud(spark, sf_dir), -1, -2)


@query(_LEVELS + _margin_sql(2, -1) + 'SELECT src, frame, "on" FROM margin')
def q_margin_mixed(spark, sf_dir):
    return segments.margin(_loud(spark, sf_dir), 2, -1)


_CHUNKS = _LEVELS.replace("WITH b AS", "WITH RECURSIVE b AS") + _margin_sql(2, 2) + _runs_sql("margin", '"on"', "chunks")


@query(_CHUNKS + 'SELECT src, "start", "end", "on" FROM chunks')
def q_margin_chunks(spark, sf_dir):
    return segments.runs(segments.margin(_loud(spark, sf_dir), 2, 2))


def _smooth(spark, sf_dir) -> DataFrame:
    return segments.smooth(q_margin_chunks(spark, sf_dir), 4, 3)


_SMOOTH = _CHUNKS + _smooth_sql(4, 3)


@query(_SMOOTH + 'SELECT src, "start", "end", "on" FROM smooth')
def q_smooth_chunks(spark, sf_dir):
    return _smooth(spark, sf_dir)


_TIMELINE = _SMOOTH + """,
speeds("on", speed) AS (VALUES (true, 1.5), (false, CAST(CAST(8.1 AS FLOAT) AS DOUBLE))),
bounds AS (SELECT src, "start" AS "at", "on", speed, CAST(ceil("start" / speed) AS BIGINT) AS "offset",
  CASE WHEN round(("end" - "start") / speed) = 0 THEN 0 ELSE CAST(ceil("end" / speed) AS BIGINT) - CAST(ceil("start" / speed) AS BIGINT) END AS dur FROM smooth JOIN speeds USING ("on")),
clips AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY "at") - 1 AS ord, CAST(coalesce(sum(dur) OVER (PARTITION BY src ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start",
  CAST(dur AS BIGINT) AS dur, "offset", CASE WHEN "on" THEN 1 ELSE 0 END AS label, CAST(speed AS DOUBLE) AS speed FROM bounds WHERE dur > 0)"""


def _actions(spark) -> DataFrame:
    """Speeds of the labels 0 and 1; the first is a product of two, stored as 32-bit numbers."""
    rows = spark.createDataFrame([(0, [8.1, 1.0]), (1, [1.5])], "label int, speeds array<double>")
    return rows.select("label", timeline.speed_product(F.col("speeds")).alias("speed"))


def _timeline(spark, sf_dir) -> DataFrame:
    labelled = _smooth(spark, sf_dir).select("src", "start", "end", F.col("on").cast("int").alias("label"))
    return timeline.clips(labelled, _actions(spark))


@query(_TIMELINE + 'SELECT src, ord, "start", dur, "offset", label, speed FROM clips')
def q_clip_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query(_LEVELS + """,
ranges(seq, "start", stop, action) AS (VALUES (0, 10, 40, 3), (1, -50, 4611686018427387903, 0), (2, 30, 60, 4), (3, 690, 715, 5)),
len AS (SELECT src, 720 AS length FROM spine GROUP BY src),
norm AS (SELECT src, seq, action, greatest(CASE WHEN "start" < 0 THEN length + "start" ELSE "start" END, 0) AS lo, least(greatest(CASE WHEN stop < 0 THEN length + stop ELSE stop END, 0), length) AS hi FROM len, ranges),
painted AS (SELECT src, frame, arg_max(action, seq) AS action FROM (SELECT src, seq, action, unnest(generate_series(lo, hi - 1)) AS frame FROM norm WHERE lo < hi) GROUP BY ALL),
joined AS (SELECT src, CAST(frame AS INT) AS frame, coalesce(action, CAST("on" AS INT)) AS action FROM loud FULL JOIN painted USING (src, frame)),
full_spine AS (SELECT src, CAST(unnest(generate_series(0, m)) AS INT) AS frame FROM (SELECT src, max(frame) AS m FROM joined GROUP BY src))
SELECT src, frame, coalesce(action, 0) AS action FROM full_spine LEFT JOIN joined USING (src, frame)""")
def q_range_override(spark, sf_dir):
    labels = _loud(spark, sf_dir).select("src", "frame", F.col("on").cast("int").alias("label"))
    ranges = spark.createDataFrame([(0, 10, 40, 3), (1, -50, (1 << 62) - 1, 0), (2, 30, 60, 4), (3, 690, 715, 5)], "seq int, start long, stop long, action int")
    lengths = labels.select("src").distinct().withColumn("length", F.lit(720).cast("long"))
    return segments.override(labels, ranges, lengths)


@query("""
WITH f AS (SELECT l_shipmode_group AS grp, min(l_orderkey * 10 + l_linenumber) AS first FROM (SELECT *, l_returnflag || '/' || l_linestatus || '/' || CAST(CAST(l_quantity AS INT) % 7 AS VARCHAR) AS l_shipmode_group FROM lineitem) GROUP BY 1),
ids AS (SELECT grp, row_number() OVER (ORDER BY first, grp) - 1 AS effects FROM f)
SELECT l_orderkey, l_linenumber, l_returnflag || '/' || l_linestatus || '/' || CAST(CAST(l_quantity AS INT) % 7 AS VARCHAR) AS grp, effects FROM lineitem JOIN ids ON ids.grp = l_returnflag || '/' || l_linestatus || '/' || CAST(CAST(l_quantity AS INT) % 7 AS VARCHAR)""")
def q_effect_dedupe(spark, sf_dir):
    group = F.concat_ws("/", "l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 7).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", group.alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return timeline.dense_effects(rows, "grp", "at").select("l_orderkey", "l_linenumber", "grp", "effects")


@query(_TIMELINE + """, lengths AS (SELECT src, max("start" + dur) AS length FROM clips GROUP BY src),
begins AS (SELECT src, coalesce(sum(length) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lengths)
SELECT src, ord, CAST("start" + b AS BIGINT) AS "start", dur, "offset" FROM clips JOIN begins USING (src)""")
def q_append_inputs(spark, sf_dir):
    return timeline.append(_timeline(spark, sf_dir), "src").select("src", "ord", "start", "dur", "offset")


_KEPT = _SMOOTH + ', kept AS (SELECT src, "start", "end" FROM smooth WHERE "on"), total AS (SELECT src, max("end") AS length FROM smooth GROUP BY src)'


@query(_KEPT + """
SELECT src, s AS "start", e - s AS cut FROM (
  SELECT src, coalesce(lag("end") OVER (PARTITION BY src ORDER BY "start"), 0) AS s, "start" AS e FROM kept
  UNION ALL SELECT t.src, coalesce(m, 0), length FROM total t LEFT JOIN (SELECT src, max("end") AS m FROM kept GROUP BY src) USING (src)) WHERE e > s""")
def q_cut_lengths(spark, sf_dir):
    own = _smooth(spark, sf_dir)
    return timeline.cut_lengths(own.where(F.col("on")), own.groupBy("src").agg(F.max("end").alias("length")))


@query("""
SELECT count(*) AS n, min(d) AS shortest, max(d) AS longest, avg(d) AS mean, median(d) AS median, CAST(sum(d) AS BIGINT) AS output, CAST(2000000 AS BIGINT) AS input, round(sum(d) / 2000000 * 100, 2) AS percent
FROM (SELECT CAST(l_quantity AS BIGINT) AS d FROM lineitem)""")
def q_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("dur"))
    lengths = spark.createDataFrame([(2_000_000,)], "length long")
    return timeline.statistics(rows, lengths)


_CUES = """
WITH q AS (SELECT conv_id AS src, turn, text, greatest(length(coalesce(text, '')), 1) AS dur FROM conversations),
cues AS (SELECT src, turn, coalesce(sum(dur) OVER (PARTITION BY src ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, dur, text FROM q WHERE text IS NOT NULL),
len AS (SELECT src, max(s + dur) AS length FROM cues GROUP BY src)
"""


def _cue_sql(condition: str) -> str:
    return _CUES + f""", spine AS (SELECT src, unnest(generate_series(0, CAST(length AS BIGINT) - 1)) AS frame FROM len),
hit AS (SELECT DISTINCT src, unnest(generate_series(CAST(s AS BIGINT), CAST(s + dur AS BIGINT) - 1)) AS frame FROM cues WHERE {condition})
SELECT src, CAST(frame AS INT) AS frame, h.frame IS NOT NULL AS "on" FROM spine LEFT JOIN hit h USING (src, frame)"""


@query(_cue_sql("regexp_matches(text, 'th[ae]n? [a-z]+ing')"))
def q_cue_regex_mask(spark, sf_dir):
    return masks.cue_mask(A.conversation_cues(table(spark, sf_dir, "conversations")), "th[ae]n? [a-z]+ing")


@query(_cue_sql(r"regexp_matches(text, '(?i)\bthe\b')"))
def q_cue_word_mask(spark, sf_dir):
    return masks.cue_mask(A.conversation_cues(table(spark, sf_dir, "conversations")), masks.word_pattern("the"), True)


@query(_CUES + """, clips AS (SELECT src, k * 300 AS "offset", 200 AS dur, k * 200 AS "start" FROM (SELECT src, unnest(generate_series(0, CAST((length - 1) // 300 AS BIGINT))) AS k FROM len))
SELECT c.src, CAST(c."start" + greatest(c."offset", q.s) - c."offset" AS BIGINT) AS "start", CAST(c."start" + least(c."offset" + c.dur, q.s + q.dur) - c."offset" AS BIGINT) AS "end", q.text
FROM clips c JOIN cues q ON c.src = q.src AND greatest(c."offset", q.s) < least(c."offset" + c.dur, q.s + q.dur)""")
def q_cue_retime(spark, sf_dir):
    cues = A.conversation_cues(table(spark, sf_dir, "conversations"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), C.whole_div(F.col("length") - 1, 300)))
    clips = cues.where("text is not null").groupBy("src").agg(F.max("end").alias("length")).select("src", k.alias("k")).select("src", (F.col("k") * 300).alias("offset"), F.lit(200).cast("long").alias("dur"), (F.col("k") * 200).alias("start"))
    return masks.cue_overlaps(cues.where("text is not null"), clips)


_TRACKS = _CLIPS.rstrip() + """,
t AS (SELECT src AS track, ord, "start", dur, "offset" + ord * (ord % 3) AS "offset", CASE WHEN ord % 4 = 0 THEN 'b' ELSE 'a' END AS media, CASE WHEN ord % 5 = 0 THEN 2.0 ELSE 1.0 END AS speed FROM c),
p AS (SELECT *, lead("start") OVER w AS rs, lead("offset") OVER w AS ro, lead(media) OVER w AS rm, lead(speed) OVER w AS rsp, lead(dur) OVER w AS rd FROM t WINDOW w AS (PARTITION BY track ORDER BY "start", ord)),
p2 AS (SELECT *, CAST(round(ro * rsp) AS BIGINT) AS rb, greatest(0, CAST(round(ro * rsp) AS BIGINT) - CAST(round(("offset" + dur) * speed) AS BIGINT)) AS cut FROM p WHERE "start" + dur = rs),
p3 AS (SELECT track, rs AS "at", least(6, dur, rd, CAST(trunc(rb / rsp) AS BIGINT), CASE WHEN media = rm THEN CAST(trunc(cut / greatest(speed, rsp)) AS BIGINT) ELSE 999999 END) * 2 AS dur FROM p2 WHERE NOT (media = rm AND cut < 1)),
centers AS (SELECT track, "at", dur FROM p3 WHERE dur > 0),
ends AS (SELECT track, arg_min("start", "start") AS fs, arg_min(dur, "start") AS fd, arg_max("start", "start") AS ls, arg_max(dur, "start") AS ld FROM t GROUP BY track),
cc AS (SELECT track, arg_min("at", "at") AS a0, arg_min(dur, "at") AS d0, arg_max("at", "at") AS a1, arg_max(dur, "at") AS d1 FROM centers GROUP BY track),
tr0 AS (SELECT track, fs AS "at", least(12, fd, coalesce(a0 - d0 // 2 - fs, 999999)) AS dur, 'start' AS alignment, 0 AS rk FROM ends LEFT JOIN cc USING (track)
  UNION ALL SELECT track, "at", dur, 'center', 1 FROM centers
  UNION ALL SELECT track, ls + ld, least(12, ld, coalesce(ls + ld - (a1 + d1 - d1 // 2), 999999)), 'end', 2 FROM ends LEFT JOIN cc USING (track)),
tr AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY "at", rk) - 1 AS ord, CAST("at" AS BIGINT) AS "at", CAST(dur AS BIGINT) AS dur, alignment FROM tr0 WHERE dur > 0)
"""


def _tracks(spark, sf_dir) -> DataFrame:
    c = _clips(spark, sf_dir)
    return c.select(
        F.col("src").alias("track"), "ord", "start", "dur", (F.col("offset") + F.col("ord") * (F.col("ord") % 3)).alias("offset"),
        F.when(F.col("ord") % 4 == 0, "b").otherwise("a").alias("media"), F.when(F.col("ord") % 5 == 0, 2.0).otherwise(1.0).alias("speed"),
    )


@query(_TRACKS + "SELECT track, ord, \"at\", dur, alignment FROM tr")
def q_dissolve_plan(spark, sf_dir):
    return transitions.dissolves(_tracks(spark, sf_dir), 12, 1)


def _lower_sql(video: bool) -> str:
    fade = "NULL" if video else "stop - odur // 2"
    return _TRACKS + f""",
f AS (SELECT track, "at", arg_min(dur, ord) AS d, arg_min(alignment, ord) AS al FROM tr GROUP BY track, "at"),
q AS (SELECT t.track, t.ord, t."start", t.dur, t."offset", t."start" + t.dur AS stop, i.d AS idur, i.al AS ial, o.d AS odur, o.al AS oal
  FROM t LEFT JOIN f i ON i.track = t.track AND i."at" = t."start" AND i.al <> 'end' LEFT JOIN f o ON o.track = t.track AND o."at" = t."start" + t.dur AND o.al <> 'start'),
q2 AS (SELECT *, CASE WHEN ial = 'center' THEN idur // 2 ELSE 0 END AS pre, CASE WHEN oal = 'center' THEN odur - odur // 2 ELSE 0 END AS post FROM q),
q3 AS (SELECT *, "start" - pre AS lo, greatest(0, "offset" - pre) AS off, stop + post AS hi FROM q2),
q4 AS (SELECT *, least(CASE WHEN ial IS NOT NULL THEN lo + idur ELSE "start" END, hi) AS ie, CASE WHEN oal = 'center' THEN {fade} WHEN oal IS NOT NULL THEN stop - odur END AS fa FROM q3),
q5 AS (SELECT *, CASE WHEN fa IS NULL THEN hi ELSE greatest(ie, least(fa, hi)) END AS os FROM q4),
parts AS (SELECT track, ord, 0 AS part, lo AS a, ie AS b, 'in' AS fade, lo, off FROM q5 UNION ALL SELECT track, ord, 1, ie, os, NULL, lo, off FROM q5 UNION ALL SELECT track, ord, 2, os, hi, 'out', lo, off FROM q5)
SELECT track, ord, part, CAST(a AS BIGINT) AS "start", CAST(b - a AS BIGINT) AS dur, CAST(off + a - lo AS BIGINT) AS "offset", fade, CAST(CASE WHEN fade IS NOT NULL THEN b - a END AS BIGINT) AS fade_dur FROM parts WHERE b > a"""


@query(_lower_sql(True))
def q_dissolve_lower_video(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return transitions.lower(t, transitions.dissolves(t, 12, 1), video=True)


@query(_lower_sql(False))
def q_dissolve_lower_audio(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return transitions.lower_dissolves(t, 12, 1, video=False)


@query(_TRACKS + """,
bad AS (SELECT track, ord, "at" + CASE WHEN ord % 2 = 1 THEN 1 ELSE 0 END AS "at", dur * 3 AS dur, alignment FROM tr),
sp AS (SELECT *, "at" - CASE alignment WHEN 'start' THEN 0 WHEN 'center' THEN dur // 2 ELSE dur END AS lo FROM bad),
sp2 AS (SELECT *, lag(lo + dur) OVER (PARTITION BY track ORDER BY ord) AS pe, lag("at") OVER (PARTITION BY track ORDER BY ord) AS pa FROM sp),
sp3 AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE t.track = sp2.track AND t."start" + t.dur = sp2."at") AS hl, EXISTS (SELECT 1 FROM t WHERE t.track = sp2.track AND t."start" = sp2."at") AS hr FROM sp2),
v AS (SELECT track, ord, CAST("at" AS BIGINT) AS "at", CASE WHEN dur <= 0 OR coalesce(lo < pe, false) OR coalesce("at" < pa, false) THEN 'overlap' WHEN alignment = 'start' AND NOT hr THEN 'no clip starts here'
  WHEN alignment = 'center' AND NOT (hl AND hr) THEN 'does not join clips' WHEN alignment = 'end' AND NOT hl THEN 'no clip ends here' END AS problem FROM sp3)
SELECT track, ord, "at", problem FROM v WHERE problem IS NOT NULL""")
def q_transition_validate(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    bad = transitions.dissolves(t, 12, 1).select("track", "ord", (F.col("at") + F.col("ord") % 2).alias("at"), (F.col("dur") * 3).alias("dur"), "alignment")
    return transitions.violations(t, bad)


@query(_LEVELS + """, sparse AS (SELECT src, frame, top FROM b WHERE frame % 5 <> 0),
r AS (SELECT src, frame, top, coalesce(lag(frame) OVER (PARTITION BY src ORDER BY frame) + 1, 0) AS low FROM sparse)
SELECT src, CAST(unnest(generate_series(low, frame)) AS INT) AS frame, top FROM r""")
def q_gap_fill(spark, sf_dir):
    sparse = A.event_frames(table(spark, sf_dir, "events")).where("frame % 5 <> 0").select("src", "frame", "top")
    return series.fill_backwards(sparse)


_KEYS = """
keys AS (SELECT src, unnest(generate_series(0, CAST(total AS BIGINT), 12)) AS frame FROM (SELECT l_orderkey AS src, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY 1))"""


@query(_CLIPS.rstrip() + "," + _KEYS + """
SELECT c.src, c.ord, CAST(c."offset" AS BIGINT) AS frame, k.frame AS keyframe FROM c ASOF LEFT JOIN keys k ON c.src = k.src AND c."offset" >= k.frame""")
def q_asof_keyframe(spark, sf_dir):
    points = _clips(spark, sf_dir).select("src", "ord", F.col("offset").alias("frame"))
    return series.keyframe_at(points, A.order_keyframes(table(spark, sf_dir, "lineitem"))).select("src", "ord", "frame", "keyframe")


_PIXELS = "WITH f AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: CAST(round((CAST(x AS DOUBLE) + 1) * 127.5) AS INT)) AS px FROM embeddings)"


def _u16_sql(x: str) -> str:
    return f"CAST(trunc(CAST({x} AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT)"


@query(_PIXELS + f""", g AS (SELECT idx, px, lag(px) OVER (ORDER BY idx) AS was FROM f)
SELECT idx, CASE WHEN was IS NULL THEN 0 ELSE {_u16_sql("len(list_filter(list_zip(was, px), lambda z: abs(z[1] - z[2]) > 0)) / len(px)")} END AS u16 FROM g""")
def q_motion(spark, sf_dir):
    return series.motion(A.embedding_frames(table(spark, sf_dir, "embeddings")), block=50).select("idx", "u16")


@query(_PIXELS + f" SELECT idx, {_u16_sql('len(list_filter(px, lambda p: p <= 115)) / len(px)')} AS u16 FROM f")
def q_black_ratio(spark, sf_dir):
    return series.blackness(A.embedding_frames(table(spark, sf_dir, "embeddings")), 0.45)


_PLAN = _CLIPS.rstrip() + "," + _KEYS + """,
ends AS (SELECT src, max(frame) + 5 AS source_end FROM keys GROUP BY src),
g AS (SELECT k.src, frame, coalesce(lead(frame) OVER (PARTITION BY k.src ORDER BY frame), source_end) AS ge, lead(frame) OVER (PARTITION BY k.src ORDER BY frame) IS NULL AS fin, source_end FROM keys k JOIN ends e ON e.src = k.src),
cl AS (SELECT src, ord, "start", "offset" AS o, "offset" + dur AS stop FROM c),
cp AS (SELECT cl.src, ord, "start", o, stop, frame AS a, ge AS b FROM cl JOIN g ON g.src = cl.src AND frame >= o AND ge <= stop AND ge > frame AND NOT (fin AND stop > source_end)),
gaps AS (SELECT src, ord, "start", o, coalesce(lag(b) OVER (PARTITION BY src, ord ORDER BY a), o) AS x, a AS y FROM cp
  UNION ALL SELECT cl.src, cl.ord, cl."start", cl.o, coalesce(r, cl.o), cl.stop FROM cl LEFT JOIN (SELECT src, ord, max(b) AS r FROM cp GROUP BY ALL) m ON m.src = cl.src AND m.ord = cl.ord),
sp AS (SELECT src, ord, 'copy' AS kind, a AS x, b AS y, "start" + a - o AS out FROM cp UNION ALL SELECT src, ord, 'encode', x, y, "start" + x - o FROM gaps WHERE y > x),
mk AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w = kind AND lag(y) OVER w = x AND lag(out + y - x) OVER w = out, false) THEN 0 ELSE 1 END AS fresh FROM sp WINDOW w AS (PARTITION BY src ORDER BY ord, x)),
nm AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY ord, x) AS n FROM mk),
spans AS (SELECT src, CAST(n AS BIGINT) AS n, any_value(kind) AS kind, CAST(min(x) AS BIGINT) AS src_start, CAST(max(y) AS BIGINT) AS src_end, CAST(min(out) AS BIGINT) AS out_start FROM nm GROUP BY src, n)"""


def _plan(spark, sf_dir):
    keys = A.order_keyframes(table(spark, sf_dir, "lineitem"))
    ends = keys.groupBy("src").agg((F.max("frame") + 5).alias("source_end"))
    groups = planner.picture_groups(keys, ends)
    return planner.render_plan(_clips(spark, sf_dir), groups), groups, ends


@query(_PLAN + " SELECT src, n, kind, src_start, src_end, out_start FROM spans")
def q_smart_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0]


@query(_PLAN + """,
st AS (SELECT src, sum(CASE WHEN kind = 'copy' THEN src_end - src_start ELSE 0 END) AS copied, sum(CASE WHEN kind = 'encode' THEN src_end - src_start ELSE 0 END) AS encoded,
  count(*) FILTER (kind = 'encode' AND coalesce(was, '') <> 'encode') AS encode_runs FROM (SELECT *, lag(kind) OVER (PARTITION BY src ORDER BY n) AS was FROM spans) GROUP BY src),
mg AS (SELECT src, greatest(sum(ge - frame) // count(*), 1) AS grp FROM g WHERE ge > frame GROUP BY src),
ln AS (SELECT src, max("start" + dur) AS tl FROM c GROUP BY src)
SELECT st.src, CAST(copied AS BIGINT) AS copied, CAST(encoded AS BIGINT) AS encoded, encode_runs, CAST(grp AS BIGINT) AS "group", copied > 0 AND tl > 0 AND encoded + source_end // 32 + encode_runs * grp < tl AS worthwhile
FROM st JOIN mg USING (src) JOIN ln USING (src) JOIN ends USING (src)""")
def q_smart_worthwhile(spark, sf_dir):
    spans, groups, ends = _plan(spark, sf_dir)
    lengths = series.media_length(_clips(spark, sf_dir).select("src", F.col("start").alias("pts"), "dur")).withColumnRenamed("length", "timeline").join(ends, "src")
    return planner.worthwhile(planner.plan_statistics(spans), lengths, groups)


_LAYERS = _CLIPS.rstrip() + """,
l AS (SELECT src // 10 AS src, CAST(src % 10 AS INT) AS layer, ord, "start" + ord * 2 AS "start", dur, "offset" FROM c)
"""


def _layers(spark, sf_dir) -> DataFrame:
    c = _clips(spark, sf_dir)
    return c.select(C.whole_div(F.col("src"), 10).alias("src"), (F.col("src") % 10).cast("int").alias("layer"), "ord", (F.col("start") + F.col("ord") * 2).alias("start"), "dur", "offset")


@query(_LAYERS + """, fr AS (SELECT src, layer, "start", "offset", unnest(generate_series("start", "start" + dur - 1)) AS frame FROM l)
SELECT src, frame, count(*) AS clips, CAST(max(layer) AS INT) AS top, CAST(sum(CAST(round(round((frame - "start" + "offset") * (24.0 / 30)) * 1.5) AS BIGINT)) AS BIGINT) AS source_frames FROM fr GROUP BY src, frame""")
def q_point_in_interval(spark, sf_dir):
    shown = mixing.source_frame(F.col("frame"), F.col("start"), F.col("offset"), F.lit(1.5), 24.0 / 30)
    # Clips, not frames, are exchanged: frames of a source are spelled out where its clips are.
    return mixing.active(_layers(spark, sf_dir).repartition("src")).groupBy("src", "frame").agg(F.count("*").alias("clips"), F.max("layer").alias("top"), F.sum(shown).alias("source_frames"))


@query(_LAYERS + """, e AS (SELECT src, "start" AS "at", layer + 1 AS d FROM l UNION ALL SELECT src, "start" + dur, -(layer + 1) FROM l),
s AS (SELECT src, "at", sum(d) AS d FROM e GROUP BY ALL)
SELECT src, "start", "end", level FROM (SELECT src, "at" AS "start", lead("at") OVER (PARTITION BY src ORDER BY "at") AS "end", CAST(sum(d) OVER (PARTITION BY src ORDER BY "at") AS BIGINT) AS level FROM s) WHERE "end" IS NOT NULL""")
def q_mix_sum(spark, sf_dir):
    return mixing.mix(_layers(spark, sf_dir).withColumn("level", (F.col("layer") + 1).cast("long")))


@query(_LAYERS + """SELECT a.src, a.layer, a.ord, b.layer AS key_layer, b.ord AS key_ord, greatest(a."start", b."start") AS "start", least(a."start" + a.dur, b."start" + b.dur) AS "end"
FROM l a JOIN l b ON a.src = b.src AND b.layer > a.layer AND greatest(a."start", b."start") < least(a."start" + a.dur, b."start" + b.dur)""")
def q_sidechain(spark, sf_dir):
    return mixing.side_chain(_layers(spark, sf_dir))


@query(_CLIPS.rstrip() + """,
f AS (SELECT src, ord, dur, unnest(generate_series("start", "start" + dur - 1)) AS frame, "start" FROM c),
p AS (SELECT src, ord, frame, CASE WHEN dur <= 1 THEN 0.0 ELSE least((frame - "start") / (dur - 1), 1.0) END AS t FROM f),
e AS (SELECT src, ord, frame, 2 * (CASE WHEN t < 0.5 THEN 2 * t * t ELSE 1 - (2 - 2 * t) * (2 - 2 * t) / 2 END) AS x FROM p)
SELECT src, ord, frame, round(CASE WHEN floor(x) >= 2 THEN 1.0 WHEN floor(x) = 0 THEN 1.0 + (0.5 - 1.0) * x ELSE 0.5 + (1.0 - 0.5) * (x - 1) END, 6) AS value FROM e""")
def q_keyframe_sample(spark, sf_dir):
    own = mixing.ramp(_clips(spark, sf_dir), [1.0, 0.5, 1.0], "inout")
    return own.select("src", "ord", "frame", F.round("value", 6).alias("value"))


@query("SELECT event_id, round(value * (0.9 / (SELECT max(abs(value)) FROM events)), 6) AS v FROM events")
def q_peak_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"))
    return mixing.normalize_peak(rows, 0.9).select("event_id", F.round("v", 6).alias("v"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e)
SELECT user_id, min(t) AS "start", max(t) AS "end", count(*) AS events FROM s GROUP BY user_id, n HAVING count(*) >= 2""")
def q_session_gate(spark, sf_dir):
    from framespan.streaming.gate import gate_batch

    rows = table(spark, sf_dir, "events").select("user_id", A.micros("ts").alias("t"), "event_id")
    return gate_batch(rows, "user_id", gap=7_200_000_000, least=2)


_V1 = _TIMELINE + """, v1 AS (SELECT src, "start", "end", CASE WHEN "on" THEN 1.0 ELSE 99999.0 END AS speed FROM smooth)"""


@query(_V1 + ' SELECT src, row_number() OVER (PARTITION BY src ORDER BY "start") - 1 AS n, "start", "end", CAST(speed AS DOUBLE) AS speed FROM v1')
def q_v1_rows(spark, sf_dir):
    from framespan.sinks.timeline_json import v1_chunks

    speed = F.when(F.col("on"), F.lit(1.0))
    nested = v1_chunks(_smooth(spark, sf_dir).select("src", "start", "end", speed.alias("speed")))
    return nested.select("src", F.posexplode("chunks").alias("n", "c")).select("src", F.col("n").cast("long").alias("n"), "c.start", "c.end", "c.speed")


@query(_V1 + """, r AS (SELECT src, "start" AS "at", row_number() OVER (PARTITION BY src ORDER BY "start") - 1 AS n, "end" - "start" AS dur FROM v1 WHERE speed < 99999 AND "end" > "start")
SELECT src, row_number() OVER (PARTITION BY src ORDER BY n) - 1 AS ord, CAST(coalesce(sum(dur) OVER (PARTITION BY src ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start", CAST(dur AS BIGINT) AS dur, CAST("at" AS BIGINT) AS "offset" FROM r""")
def q_v1_round_trip(spark, sf_dir):
    from framespan.sinks.timeline_json import v1_json
    from framespan.sources.timeline_json import read_v1

    chunks = _smooth(spark, sf_dir).select("src", "start", "end", F.when(F.col("on"), F.lit(1.0)).alias("speed"))
    return read_v1(v1_json(chunks, "30/1"), "json").select("src", "ord", "start", "dur", "offset")


@query(_TIMELINE + ' SELECT src, ord, "start", dur, "offset", CASE WHEN label = 0 THEN \'speed:8.1\' ELSE \'speed:1.5\' END AS effect FROM clips')
def q_v3_nested(spark, sf_dir):
    from framespan.sinks.timeline_json import v3_json
    from framespan.sources.timeline_json import read_v3

    rows = _timeline(spark, sf_dir).select("src", "ord", "start", "dur", "offset", F.lit(0).alias("stream"), F.array(F.when(F.col("label") == 0, "speed:8.1").otherwise("speed:1.5")).alias("effects"), F.lit("v").alias("kind"), F.lit(0).alias("layer"))
    back = read_v3(v3_json(rows, "30/1"), "json")
    return back.select("src", "ord", "start", "dur", "offset", F.col("effects")[0].alias("effect"))


@query("SELECT DISTINCT CAST(l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS BIGINT) AS frame FROM lineitem")
def q_sort_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).cast("long").alias("frame")).distinct().orderBy("frame")


@query("SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) > 255")
def q_top_oldest(spark, sf_dir):
    """The orders beyond the newest 255."""
    from framespan.sinks.dumps import keep_newest

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return keep_newest(orders, 255).select(F.col("path").alias("o_orderkey"), F.col("mtime").alias("o_orderdate"))


@query("""
WITH d AS (SELECT p_partkey, t, levenshtein(lower(split_part(p_name, ' ', 1)), t) AS dist FROM part, (VALUES ('almond'), ('antique'), ('blue'), ('green'), ('widget'), ('chocolate')) AS k(t))
SELECT p_partkey, arg_min(t, dist * 100 + length(t) * 0 + ascii(t) * 0.0001 + ascii(t[2]) * 0.0000001) AS nearest, min(dist) AS distance FROM d GROUP BY p_partkey""")
def q_levenshtein_nearest(spark, sf_dir):
    known = F.array(*(F.struct(F.levenshtein(F.lower(F.substring_index("p_name", " ", 1)), F.lit(t)).alias("d"), F.lit(t).alias("t")) for t in ("almond", "antique", "blue", "green", "widget", "chocolate")))
    best = table(spark, sf_dir, "part").select("p_partkey", F.array_min(known).alias("b"))
    return best.select("p_partkey", F.col("b.t").alias("nearest"), F.col("b.d").cast("long").alias("distance"))


@query("""
WITH m AS (SELECT DISTINCT CAST(l_extendedprice * 100 AS BIGINT) AS ms FROM lineitem)
SELECT ms, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS standard,
  lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt,
  CAST((ms + 5) // 10 // 360000 AS VARCHAR) || ':' || lpad(CAST((ms + 5) // 10 // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((ms + 5) // 10 // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((ms + 5) // 10 % 100 AS VARCHAR), 2, '0') AS ass,
  CAST((ms + 500) // 3600000 AS VARCHAR) || ':' || lpad(CAST((ms + 500) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((ms + 500) // 1000 % 60 AS VARCHAR), 2, '0') AS display FROM m""")
def q_timecode(spark, sf_dir):
    ms = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * 100).cast("double").alias("x")).select(F.round("x").cast("long").alias("ms")).distinct()
    return ms.select("ms", *(C.timecode(F.col("ms"), s).alias(s) for s in ("standard", "srt", "ass", "display")))


@query(_LEVELS + _margin_sql(0, 0).replace("CASE  ELSE \"on\" END", '"on"') + """,
e AS (SELECT src, frame, coalesce(a."on", false) OR coalesce(b."on", false) AS "on" FROM loud a FULL JOIN (SELECT src, frame, NOT "on" AS "on" FROM busy) b USING (src, frame))
SELECT src, frame, "on" FROM e""")
def q_edit_expression(spark, sf_dir):
    """``or audio:20% (not motion:0.15)`` with the two level series as methods: one projection."""
    levels = _levels(spark, sf_dir)
    own = {"audio": F.col("u16"), "motion": F.when(F.col("frame") < 600, F.col("u16_count"))}
    expression = lang.compile_column(lang.parse("or audio:20% (not motion:0.15)"), lambda method, bound: own[method], F.lit(1 << 30), F.col("frame"))
    return masks.as_mask(levels, expression)


@query(_TIMELINE + """, adds(seq, selector, path, follow) AS (VALUES (0, 1, 'logo.png', false), (1, 0, 'cam2.mp4', true), (2, 9, 'none.png', true))
SELECT CAST(seq + 1 AS INT) AS layer, path AS media, src, "start", dur, CASE WHEN follow THEN "offset" ELSE 0 END AS "offset" FROM clips JOIN adds ON label = selector""")
def q_overlay(spark, sf_dir):
    adds = spark.createDataFrame([(0, 1, "logo.png", False), (1, 0, "cam2.mp4", True), (2, 9, "none.png", True)], "seq int, selector int, path string, follow_base boolean")
    return timeline.overlays(_timeline(spark, sf_dir), adds)


@query(_LEVELS + f"SELECT src, frame, u16, round(u16 / 65535, 6) AS value, CAST(trunc(CAST(u16 / 65535 AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT) AS again FROM levels")
def q_quantize(spark, sf_dir):
    return _levels(spark, sf_dir).select("src", "frame", "u16", F.round(C.u16_value(F.col("u16")), 6).alias("value"), C.u16(C.u16_value(F.col("u16"))).alias("again"))


@query(_LAYERS + """SELECT src, max(e) AS length FROM (SELECT src, layer, arg_max("start" + dur, ord) AS e FROM l GROUP BY src, layer) GROUP BY src""")
def q_timeline_length(spark, sf_dir):
    return timeline.timeline_length(_layers(spark, sf_dir))


@query(_CLIPS.rstrip() + "," + _KEYS + """, d AS (SELECT src, lead(frame) OVER (PARTITION BY src ORDER BY frame) - frame AS gap FROM keys)
SELECT src, CAST(greatest(sum(gap) // count(*), 1) AS BIGINT) AS "interval" FROM d WHERE gap IS NOT NULL GROUP BY src""")
def q_keyframe_interval(spark, sf_dir):
    return planner.mean_interval(A.order_keyframes(table(spark, sf_dir, "lineitem")))


@query(_CLIPS.rstrip() + """, m AS (SELECT *, coalesce(lag("start" + dur) OVER w = "start" AND lag("offset" + dur) OVER w = "offset", false) AS jl FROM c WINDOW w AS (PARTITION BY src ORDER BY "start", ord))
SELECT src, ord, jl AS joined_left, coalesce(lead(jl) OVER (PARTITION BY src ORDER BY "start", ord), false) AS joined_right FROM m""")
def q_same_run(spark, sf_dir):
    return mixing.same_run(_clips(spark, sf_dir)).select("src", "ord", "joined_left", "joined_right")


@query(_PIXELS + """, k AS (SELECT idx, px FROM f)
SELECT idx, CAST(list_sum(list_transform(px, lambda p: 255 - p)) AS BIGINT) AS inverted, CAST(list_sum(list_transform(px, lambda p: CAST(least(greatest(round(p + 51.0), 0), 255) AS INT))) AS BIGINT) AS brighter,
  CAST(list_sum(list_transform(px, lambda p: CAST(least(greatest(round((p - 128) * 1.5 + 128), 0), 255) AS INT))) AS BIGINT) AS contrasted,
  CAST(list_sum(list_transform(px, lambda p, i: least(p, coalesce(px[i - 1], p), coalesce(px[i + 1], p)))) AS BIGINT) AS eroded, px[len(px)] AS flipped FROM k""")
def q_pixel_kernels(spark, sf_dir):
    from framespan.operators import kernels as K

    f = A.embedding_frames(table(spark, sf_dir, "embeddings"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    px = F.col("px")
    return f.select("idx", total(K.invert(px)).alias("inverted"), total(K.brightness(px, 0.2)).alias("brighter"), total(K.contrast(px, 1.5)).alias("contrasted"), total(K.erosion(px)).alias("eroded"), K.hflip(px)[0].alias("flipped"))


@query("SELECT l_orderkey AS src, count(DISTINCT l_partkey) AS sources FROM lineitem GROUP BY 1")
def q_distinct_sources(spark, sf_dir):
    return timeline.distinct_sources(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("media")))


@query(_CLIPS + 'SELECT src, bool_or(ord % 5 IN (3, 4)) AS "any" FROM c GROUP BY src')
def q_layer_bits(spark, sf_dir):
    return timeline.selected_any(_clips(spark, sf_dir).withColumn("label", (F.col("ord") % 5).cast("int")), [3, 4])


@query(_LAYERS + """SELECT src, layer, s AS "start", "start" - s AS dur FROM (SELECT *, coalesce(lag("start" + dur) OVER (PARTITION BY src, layer ORDER BY "start", ord), 0) AS s FROM l) WHERE "start" > s""")
def q_gap_rows(spark, sf_dir):
    return timeline.gap_rows(_layers(spark, sf_dir))


@query(_TRACKS + """, f AS (SELECT track, "at", arg_min(alignment, ord) AS al FROM tr GROUP BY track, "at")
SELECT t.track, t.ord, CAST(count(*) FILTER (f.al = 'center') OVER (PARTITION BY t.track ORDER BY t."start", t.ord) % 2 AS INT) AS parity FROM t LEFT JOIN f ON f.track = t.track AND f."at" = t."start" AND f.al <> 'end'""")
def q_playlist_parity(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return timeline.playlist_parity(transitions.plan(t, transitions.dissolves(t, 12, 1))).select("track", "ord", "parity")


@query("""
WITH r AS (SELECT l_orderkey // 100 AS src, l_partkey % 7 AS media, CAST(l_quantity AS BIGINT) AS "start", l_orderkey * 100 + l_linenumber AS "at", l_suppkey FROM lineitem),
f AS (SELECT src, media, "start", min("at") AS first FROM r GROUP BY ALL),
i AS (SELECT src, media, "start", row_number() OVER (PARTITION BY src ORDER BY first, media, "start") AS link FROM f)
SELECT src, media, "start", count(*) AS clips, link FROM r JOIN i USING (src, media, "start") GROUP BY ALL""")
def q_link_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(C.whole_div(F.col("l_orderkey"), 100).alias("src"), (F.col("l_partkey") % 7).alias("media"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return timeline.link_ids(rows).groupBy("src", "media", "start", "link").agg(F.count("*").alias("clips"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS v FROM orders),
d AS (SELECT o_custkey, arg_min(v, o_orderkey) AS resolved FROM r WHERE v IS NOT NULL GROUP BY 1)
SELECT o_orderkey, o_custkey, resolved FROM r LEFT JOIN d USING (o_custkey)""")
def q_file_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("v"))
    return timeline.first_definition(rows, "o_custkey", "v", "o_orderkey").select("o_orderkey", "o_custkey", "resolved")


@query("""
WITH m AS (SELECT 'p' || p_partkey || '.mp4' AS path, p_partkey FROM part), f AS (SELECT 'p' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.srt' ELSE '.txt' END AS path FROM supplier)
SELECT path, p_partkey FROM m WHERE regexp_replace(path, '[.][^.]*$', '') IN (SELECT regexp_replace(path, '[.][^.]*$', '') FROM f WHERE path LIKE '%.srt')""")
def q_sidecar_media(spark, sf_dir):
    media = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".mp4")).alias("path"), "p_partkey")
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, ".srt").otherwise(".txt")).alias("path"))
    return timeline.with_sidecar(media, files)


@query("""
WITH x AS (SELECT p_partkey, p_size * 40 AS w, p_size * 40 * 9 // 16 + p_partkey % 4 AS h FROM part),
a(k, r, an, bn) AS (VALUES (0, '1:1', 1, 1), (1, '4:3', 4, 3), (2, '3:2', 3, 2), (3, '16:10', 16, 10), (4, '16:9', 16, 9), (5, '21:9', 21, 9), (6, '9:16', 9, 16), (7, '3:4', 3, 4), (8, '2:3', 2, 3), (9, '5:4', 5, 4), (10, '4:5', 4, 5), (11, '239:100', 239, 100), (12, '185:100', 185, 100)),
d AS (SELECT p_partkey, w, h, abs(w * bn / an - h) AS off, k, r FROM x, a),
b AS (SELECT p_partkey, w, h, min({'o': off, 'k': k, 'r': r}) AS m FROM d GROUP BY ALL)
SELECT p_partkey, CAST(w AS INT) AS w, CAST(h AS INT) AS h, CASE WHEN m.o <= 2 THEN m.r END AS ratio, CAST(greatest(2, round(w * 0.5 / 2) * 2) AS INT) AS half_w FROM b""")
def q_aspect_ratio(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).cast("int").alias("w"), (C.whole_div(F.col("p_size") * 40 * 9, 16) + F.col("p_partkey") % 4).cast("int").alias("h"))
    return x.select("p_partkey", "w", "h", C.aspect_ratio(F.col("w"), F.col("h")).alias("ratio"), C.even_size(F.col("w"), F.col("h"), 0.5)[0].alias("half_w"))


@query("""
WITH s AS (SELECT event_type AS src, CAST(user_id % 2 AS INT) AS stream, CAST(event_id % 3 AS INT) AS channel, CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS INT) AS frame, CAST(least(value / 500, 1) * 65535 AS INT) AS u16 FROM events)
SELECT src, frame, max(u16) AS u16 FROM s WHERE (stream = 0 AND channel = 0) OR (stream = 1 AND channel = 0) GROUP BY ALL""")
def q_channel_select(spark, sf_dir):
    frame = C.whole_div(A.micros("ts") - A.EPOCH_US, A.HOUR_US).cast("int")
    level = F.round(F.least(F.col("value") / 500, F.lit(1.0)) * 65535).cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), (F.col("user_id") % 2).cast("int").alias("stream"), (F.col("event_id") % 3).cast("int").alias("channel"), frame.alias("frame"), level.alias("u16"))
    return series.selected_levels(rows, {0: "stereo", 1: "mono"}, "all", "left")


@query(_CLIPS.rstrip() + """, m AS (SELECT *, coalesce(lag("start" + dur) OVER w = "start" AND lag("offset" + dur) OVER w = "offset", false) AS jl FROM c WINDOW w AS (PARTITION BY src ORDER BY "start", ord)),
m2 AS (SELECT *, coalesce(lead(jl) OVER (PARTITION BY src ORDER BY "start", ord), false) AS jr FROM m),
f AS (SELECT src, ord, dur, jl, jr, unnest(generate_series(0, dur - 1)) AS local FROM m2)
SELECT src, ord, local, round(100 * least(CASE WHEN jl THEN 1 ELSE least((local + 1) / 5, 1) END, CASE WHEN jr THEN 1 ELSE least((dur - local) / 5, 1) END), 6) AS v FROM f""")
def q_edge_fade(spark, sf_dir):
    own = _clips(spark, sf_dir)
    samples = own.select("src", "ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dur") - 1)).alias("local"), F.lit(100.0).alias("v"))
    return mixing.micro_fade(samples, own, 5).select("src", "ord", "local", F.round("v", 6).alias("v"))


_ENVELOPE_STEP = "lambda acc, x: list_concat(acc, [CASE WHEN x[1] > 5e-1 THEN 2e-1 ELSE 1e0 END + (acc[-1] - CASE WHEN x[1] > 5e-1 THEN 2e-1 ELSE 1e0 END) * CASE WHEN (CASE WHEN x[1] > 5e-1 THEN 2e-1 ELSE 1e0 END) < acc[-1] THEN 5e-1 ELSE 9e-1 END])"


@query(f"""
WITH s AS (SELECT event_type AS src, user_id AS u, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS idx, value / 100 AS k FROM events),
a AS (SELECT src, u, list(CAST(k AS DOUBLE) ORDER BY idx) AS ks FROM s GROUP BY ALL),
e AS (SELECT src, u, list_reduce(list_concat([[CAST(1.0 AS DOUBLE)]], list_transform(ks, lambda k: [k])), {_ENVELOPE_STEP}) AS g FROM a)
SELECT src, u, CAST(i AS BIGINT) AS idx, g[i + 2] AS gain FROM e, unnest(generate_series(0, len(g) - 2)) AS t(i)""")
def q_duck_envelope(spark, sf_dir):
    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.col("user_id").alias("u"), (F.row_number().over(order) - 1).alias("idx"), (F.col("value") / 100).alias("k"))
    return mixing.gains(rows.withColumn("idx", F.col("idx").cast("long")), ("src", "u"), 0.5, 0.2, 0.5, 0.9)


@query(_LEVELS + """SELECT src, CAST(frame + 1 AS BIGINT) AS line, CAST(u16 AS VARCHAR) AS text FROM levels UNION ALL SELECT src, 0, '@start' FROM spine GROUP BY src UNION ALL SELECT src, CAST(max(frame) + 2 AS BIGINT), '' FROM spine GROUP BY src""")
def q_level_lines(spark, sf_dir):
    from framespan.sinks.dumps import level_lines

    return level_lines(_levels(spark, sf_dir), raw=True)


@query("""
WITH s AS (SELECT conv_id AS src, turn * 2500 AS a, turn * 2500 + 1700 AS b, text FROM conversations WHERE text IS NOT NULL),
c AS (SELECT src, a, b, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY a, b, text) AS n FROM c WHERE text <> '')
SELECT src, n, n || chr(10) || lpad(CAST(a // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') || ' --> '
  || lpad(CAST(b // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(b % 1000 AS VARCHAR), 3, '0') || chr(10) || text || chr(10) AS text FROM n""")
def q_transcript_srt(spark, sf_dir):
    from framespan.sinks.dumps import clean_transcript, transcript

    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("src"), (F.col("turn") * 2500).alias("start_ms"), (F.col("turn") * 2500 + 1700).alias("end_ms"), "text")
    return transcript(clean_transcript(rows), "srt")


@query("""
WITH s AS (SELECT conv_id AS src, turn * 2500 AS a, turn * 2500 + 1700 AS b, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL)
SELECT src, CAST(a AS BIGINT) AS start_ms, CAST(b AS BIGINT) AS end_ms, text FROM s WHERE text <> ''""")
def q_srt_round_trip(spark, sf_dir):
    from framespan.sources.subtitles import read_srt

    blocks = q_transcript_srt(spark, sf_dir)
    files = blocks.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return read_srt(files)


@query(_SMOOTH + """,
v2 AS (SELECT src, "start", "end", CASE WHEN "on" THEN 'speed:1.5' ELSE 'speed:8' END AS eff, CASE WHEN "on" THEN 1.5 ELSE 8.0 END AS sp FROM smooth),
b2 AS (SELECT src, "start" AS pos, eff, CAST(ceil("start" / sp) AS BIGINT) AS "offset", CASE WHEN round(("end" - "start") / sp) = 0 THEN 0 ELSE CAST(ceil("end" / sp) AS BIGINT) - CAST(ceil("start" / sp) AS BIGINT) END AS dur FROM v2),
k2 AS (SELECT * FROM b2 WHERE dur > 0),
fx AS (SELECT src, eff, row_number() OVER (PARTITION BY src ORDER BY min(pos)) - 1 AS effects FROM k2 GROUP BY src, eff)
SELECT k2.src, row_number() OVER (PARTITION BY k2.src ORDER BY pos) - 1 AS ord, CAST(coalesce(sum(dur) OVER (PARTITION BY k2.src ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start", CAST(dur AS BIGINT) AS dur, "offset", effects
FROM k2 JOIN fx ON fx.src = k2.src AND fx.eff = k2.eff""")
def q_v2_round_trip(spark, sf_dir):
    from framespan.sinks.timeline_json import v2_json
    from framespan.sources.timeline_json import read_v2

    rows = _smooth(spark, sf_dir).select("src", "start", "end", F.array(F.when(F.col("on"), "speed:1.5").otherwise("speed:8")).alias("effects"))
    return read_v2(v2_json(rows, "30/1"), "json").select("src", "ord", "start", "dur", "offset", "effects")


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), r(rate) AS (VALUES (8000), (11025), (12000), (16000), (22050), (24000), (32000), (44100), (48000), (88200), (96000)),
x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 100000 AS want FROM f)
SELECT o_orderkey, want, CAST(min({'d': abs(rate - want), 'r': rate}).r AS INT) AS rate FROM x, r GROUP BY ALL""")
def q_nearest_rate(spark, sf_dir):
    from framespan.sources.media import nearest_rate

    x = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") % 100000).cast("long").alias("want"))
    return x.select("o_orderkey", "want", nearest_rate(F.col("want")).alias("rate"))


from framespan import queries_more  # noqa: E402, F401 (registers its queries, which build on those above)
