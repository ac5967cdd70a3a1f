"""More registered queries: tables of masks and labels, the gate, values and flags of plans, text forms, documents, kernels."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan import queries as Q
from framespan.functions import columns as C
from framespan.functions import values as V
from framespan.operators import kernels as K
from framespan.operators import masks, mixing, pictures, segments, series, timeline
from framespan.plans import actions as P
from framespan.plans import chain
from framespan.plans import edit_language as lang
from framespan.plans import flags as G
from framespan.registry import query, table
from framespan.sources import adapters as A


def _busy(spark, sf_dir) -> DataFrame:
    return masks.as_mask(Q._levels(spark, sf_dir), Q._busy_column())


def _third(spark, sf_dir) -> DataFrame:
    """Frames of odd number up to the 400th."""
    return Q._levels(spark, sf_dir).where("frame < 400").select("src", "frame", (F.col("frame") % 2 == 1).alias("on"))


_THIRD = ', odd AS (SELECT src, frame, frame % 2 = 1 AS "on" FROM levels WHERE frame < 400)'


@query(Q._LEVELS + _THIRD + """SELECT src, frame, a."on" AND b."on" AND c."on" AS "on" FROM loud a JOIN busy b USING (src, frame) JOIN odd c USING (src, frame)""")
def q_mask_all(spark, sf_dir):
    """``and`` of three tables of their own lengths."""
    return masks.all_of([Q._loud(spark, sf_dir), _busy(spark, sf_dir), _third(spark, sf_dir)])


@query(Q._LEVELS + _THIRD + """SELECT src, frame, (coalesce(a."on", false)::INT + coalesce(b."on", false)::INT + coalesce(c."on", false)::INT) % 2 = 1 AS "on" FROM loud a FULL JOIN busy b USING (src, frame) FULL JOIN odd c USING (src, frame)""")
def q_mask_odd(spark, sf_dir):
    """``xor`` of three tables of their own lengths."""
    return masks.odd_of([Q._loud(spark, sf_dir), _busy(spark, sf_dir), _third(spark, sf_dir)])


_MERGED = """, merged AS (SELECT src, frame, CASE WHEN coalesce(c."on", false) THEN 7 WHEN coalesce(b."on", false) THEN 2 WHEN a."on" THEN 1 ELSE 0 END AS label FROM loud a FULL JOIN busy b USING (src, frame) FULL JOIN odd c USING (src, frame))"""


def _merged(spark, sf_dir) -> DataFrame:
    return masks.merge_labels([(1, Q._loud(spark, sf_dir)), (7, _third(spark, sf_dir)), (2, _busy(spark, sf_dir))])


@query(Q._LEVELS + _THIRD + _MERGED + "SELECT src, frame, label FROM merged")
def q_label_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(Q._LEVELS + Q._margin_sql(1, 1) + _THIRD + _MERGED + """SELECT src, frame, CASE WHEN NOT coalesce(m."on", false) THEN 0 WHEN coalesce(label, 0) = 0 THEN 1 ELSE label END AS label FROM merged FULL JOIN margin m USING (src, frame)""")
def q_fold_back(spark, sf_dir):
    """Labels of tables, after a margin was put around one of their masks."""
    return masks.fold_back(_merged(spark, sf_dir), segments.margin(Q._loud(spark, sf_dir), 1, 1))


@query("""
WITH s AS (SELECT event_type AS src, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)
SELECT src, CAST(idx % 3 AS INT) AS channel, CAST(idx // 3 // 128 * 128 AS BIGINT) AS bucket_start, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi FROM s GROUP BY ALL""")
def q_waveform_channels(spark, sf_dir):
    """Peaks of interleaved samples, all channels in one pass."""
    s = A.event_samples(table(spark, sf_dir, "events"))
    s = s.select("src", (F.col("idx") % 3).cast("int").alias("channel"), C.whole_div(F.col("idx"), 3).alias("idx"), "v")
    return series.waveform(s, 128, channel="channel")


@query("""
WITH s AS (SELECT event_type AS src, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events),
b AS (SELECT src, idx // 256 AS b, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi FROM s GROUP BY ALL),
h AS (SELECT DISTINCT src FROM b)
SELECT src, row_number() OVER (PARTITION BY src ORDER BY b) + 1 AS line, CAST(round(lo) AS BIGINT) || ',' || CAST(round(hi) AS BIGINT) AS text FROM b
UNION ALL SELECT src, 0, '@start' FROM h UNION ALL SELECT src, 1, '@offset 0' FROM h""")
def q_waveform_lines(spark, sf_dir):
    from framespan.sinks.dumps import waveform_lines

    return waveform_lines(Q.q_waveform_minmax(spark, sf_dir))


@query(Q._LEVELS.replace("WITH b AS", "WITH RECURSIVE b AS") + """,
g AS (SELECT src, CAST(-1 AS INT) AS i, CAST(-1 AS INT) AS s, CAST(-1 AS INT) AS l, CAST(0 AS INT) AS c, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS z, CAST(NULL AS INT) AS n FROM spine GROUP BY src
  UNION ALL SELECT src, i, CASE WHEN shut THEN -1 ELSE s END, l, c, CASE WHEN shut AND c >= 3 THEN s END, CASE WHEN shut AND c >= 3 THEN least(l + 5, i) + CASE WHEN i - l >= 5 THEN 0 ELSE 1 END END, CASE WHEN shut AND c >= 3 THEN c END FROM (
    SELECT src, frame AS i, s, l, c, s >= 0 AND (frame - l >= 5 OR frame + 1 - s >= 40) AS shut FROM (
      SELECT g.src, o.frame, CASE WHEN o."on" AND g.s < 0 THEN greatest(o.frame - 2, 0) ELSE g.s END AS s, CASE WHEN o."on" THEN o.frame ELSE g.l END AS l, CASE WHEN NOT o."on" THEN g.c WHEN g.s < 0 THEN 1 ELSE g.c + 1 END AS c
      FROM g JOIN loud o ON o.src = g.src AND o.frame = g.i + 1)))
SELECT src, CAST(a AS BIGINT) AS "start", CAST(z AS BIGINT) AS "end", CAST(n AS BIGINT) AS count FROM g WHERE a IS NOT NULL""")
def q_voice_gate(spark, sf_dir):
    """The gate's rules (silence that closes it, least loud windows, preroll, longest) over windows that are loud or not."""
    from framespan.streaming.gate import gate_table

    windows = Q._loud(spark, sf_dir).select("src", F.col("frame").cast("long").alias("idx"), F.col("on").alias("loud"))
    return gate_table(windows, silence=5, least=3, preroll=2, longest=40)


_ONE = Q._LEVELS + """,
f AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: CAST(round((CAST(x AS DOUBLE) + 1) * 127.5) AS INT)) AS px FROM embeddings),
audio AS (SELECT frame, u16 >= 13107 AS "on" FROM levels WHERE src = 'click'),
motion AS (SELECT CAST(idx AS INT) AS frame, coalesce(len(list_filter(list_zip(was, px), lambda z: z[1] <> z[2])) / len(px) >= 0.5, false) AS "on" FROM (SELECT *, lag(px) OVER (ORDER BY idx) AS was FROM f)),
dark AS (SELECT CAST(idx AS INT) AS frame, len(list_filter(px, lambda p: p <= 115)) / len(px) >= 0.35 AS "on" FROM f),
q AS (SELECT turn, text, greatest(length(coalesce(text, '')), 1) AS dur FROM conversations WHERE conv_id = 0),
cue AS (SELECT coalesce(sum(dur) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, dur, text FROM q),
words AS (SELECT CAST(fr AS INT) AS frame, EXISTS (SELECT 1 FROM cue WHERE text IS NOT NULL AND regexp_matches(text, '(?i)\\bthe\\b') AND fr >= s AND fr < s + dur) AS "on" FROM generate_series(0, CAST((SELECT max(s + dur) FROM cue WHERE text IS NOT NULL) - 1 AS BIGINT)) AS t(fr))"""


@query(_ONE + """
SELECT 'x' AS src, frame, (coalesce(m."on", false) AND NOT coalesce(a."on", true)) OR coalesce(w."on", false) <> coalesce(d."on", false) AS "on"
FROM audio a FULL JOIN motion m USING (frame) FULL JOIN words w USING (frame) FULL JOIN dark d USING (frame)""")
def q_edit_media(spark, sf_dir):
    """``(or (and motion:50% (not audio:20%)) (xor word:the blackdetect:35%))``: operands from sound, pictures and subtitles, of their own lengths."""
    one = F.lit("x").alias("src")
    frames = A.embedding_frames(table(spark, sf_dir, "embeddings"))
    levels = {
        "audio": Q._levels(spark, sf_dir).where("src = 'click'").select(one, "frame", "u16"),
        "motion": series.motion(frames).select(one, F.col("idx").cast("int").alias("frame"), "u16"),
        "blackdetect": series.blackness(frames, 0.45).select(one, F.col("idx").cast("int").alias("frame"), "u16"),
    }
    cues = A.conversation_cues(table(spark, sf_dir, "conversations").where("conv_id = 0")).select(one, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text")
    lengths = levels["audio"].groupBy("src").agg((F.max("frame") + 1).alias("length"))
    context = lang.Context(lambda method, bound: levels[method], lengths, lambda stream: cues)
    return lang.compile_mask(lang.parse("(or (and motion:50% (not audio:20%)) (xor word:the blackdetect:35%))"), context)


def _by_text(rows: DataFrame, kind: str, read) -> DataFrame:
    """``rows`` with a column ``out`` (of type ``kind``) that ``read``, a function of plan-time texts, makes of the column ``t``."""

    @F.pandas_udf(kind)
    def each(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) for x in t])

    return rows.withColumn("out", each("t"))


@query("""
WITH q AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT q, round(q / 100, 9) AS threshold, q * 1000 + 500 AS ms, CAST(round((q * 1000 + 500) * 30 / 1001) AS BIGINT) AS frames, q * 1500 AS bitrate, q * 25 + 7 + 3600 * 25 AS smpte,
  (q * 60 + 5) * 30 + 12 - 2 * (q - q // 10) AS drop_frame, CASE WHEN q = 30 THEN '30000/1001' WHEN q = 24 THEN '24000/1001' ELSE CAST(q AS VARCHAR) || '/1' END AS timebase,
  CASE WHEN q = 30 OR q = 24 THEN 'true' ELSE 'false' END AS ntsc, CAST(q * 5 AS INT) AS green FROM q""")
def q_plan_values(spark, sf_dir):
    """Thresholds, times, bitrates, timecodes, rates and colours as a user writes them."""
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q")).distinct()

    def read(t: str) -> dict:
        n = int(t)
        near = {30: "29.97", 24: "23.976"}.get(n, t)
        rate = V.sane_timebase(V.rational(near))
        frames = V.time(f"{t}.5sec").frames(Fraction(30000, 1001))
        return {
            "threshold": round(V.threshold(f"{t}%"), 9), "ms": V.time(f"{t}.5sec").n, "frames": frames, "bitrate": V.bitrate(f"{n * 1.5}k"),
            "smpte": V.smpte_frames(f"01:00:{n:02d}:07", 25), "drop_frame": V.smpte_frames(f"00:{n:02d}:05;12", 30),
            "timebase": f"{rate.numerator}/{rate.denominator}", "ntsc": str(V.ntsc_rate(rate)[1]).lower(), "green": V.colour(f"#00{n * 5:02x}ff")[1],
        }

    kind = "threshold double, ms long, frames long, bitrate long, smpte long, drop_frame long, timebase string, ntsc string, green int"
    return _by_text(q.select("q", F.col("q").cast("string").alias("t")), kind, read).select("q", "out.*")


@query("""
WITH a AS (SELECT DISTINCT l_linenumber AS n, CAST(l_quantity AS INT) % 10 AS k FROM lineitem)
SELECT CAST(n AS INT) AS n, CAST(k AS INT) AS k, CASE WHEN k = 0 THEN 'cut' ELSE 'speed:' || (n + 1) || ',volume:0.' || k || ',opacity:0..0.' || k || ':ease=in:2sec' END AS canonical,
  CASE WHEN k > 0 THEN CAST(n + 1 AS DOUBLE) END AS speed, 'volume:2,invert' AS again, CAST(n * 10 AS BIGINT) AS low, CAST(n * 10 + k AS BIGINT) AS high, 'p' || k || ':q.png' AS path, k % 2 = 0 AS follow FROM a""")
def q_plan_actions(spark, sf_dir):
    """Lists of actions in canonical form, their speeds, range flags and overlays."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("n"), (F.col("l_quantity").cast("int") % 10).alias("k")).distinct()

    def read(t: str) -> dict:
        n, k = map(int, t.split("/"))
        own = P.parse_list(f"cut,speed:{n}" if k == 0 else f"speed:{n + 1},volume:0.{k},ease:in:2sec,opacity:0..0.{k}")
        (flag,) = G.overrides([("set-action", f"volume:2,invert,{n * 10},{n * 10 + k}")])
        _, _, low, high = flag.row(Fraction(30), 2)
        spec = P.overlay_spec(f"add:p{k}:q.png:1:2" + (":follow-base=0" if k % 2 else ""))
        return {"canonical": P.canonical(own), "speed": P.speed(own), "again": flag.action, "low": low, "high": high, "path": spec["path"], "follow": spec["follow_base"]}

    kind = "canonical string, speed double, again string, low long, high long, path string, follow boolean"
    return _by_text(a.withColumn("t", F.concat_ws("/", "n", "k")), kind, read).select("n", "k", "out.*")


@query("""
WITH k AS (SELECT DISTINCT p_size AS k FROM part)
SELECT CAST(k AS INT) AS k, CAST(k AS BIGINT) AS label, CAST(k * 1000 AS BIGINT) AS fade_ms, CAST(k AS BIGINT) AS min_cut, CAST(-k AS DOUBLE) AS peak, CASE k % 4 WHEN 0 THEN 'premiere' WHEN 1 THEN 'final-cut-pro' WHEN 2 THEN 'kdenlive' ELSE 'otio' END AS export,
  'n, ' || k AS name, CASE WHEN k % 2 = 0 THEN 'audio,video' ELSE 'subtitle' END AS needs FROM k""")
def q_plan_flags(spark, sf_dir):
    """Labels, transitions, normalizers and exports as a user writes them, and what media an edit needs."""
    k = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("k")).distinct()

    def read(t: str) -> dict:
        n = int(t)
        _, fade, cut = G.transition(f"dissolve:{n}sec:{n}")
        _, options = G.export(f'premiere:name="n, {n}",version=11')
        kind, _ = G.export(None, "out." + ("xml", "fcpxml", "kdenlive", "otio")[n % 4])
        needs = lang.media_needed(lang.parse("(or audio (not motion))" if n % 2 == 0 else "word:hi"))
        return {"label": G.labelled(t), "fade_ms": fade.n, "min_cut": cut.n, "peak": float(G.normalizer(f"peak:-{n}")["t"]), "export": kind, "name": options["name"], "needs": ",".join(sorted(needs))}

    kind = "label long, fade_ms long, min_cut long, peak double, export string, name string, needs string"
    return _by_text(k.withColumn("t", F.col("k").cast("string")), kind, read).select("k", "out.*")


@query("""
SELECT p_partkey, '#' || lower(lpad(to_hex(p_size * 5), 2, '0')) || '10' || lower(lpad(to_hex(p_partkey % 256), 2, '0')) AS colour, CAST(CAST(floor((p_size * 37 % 360) / 360 * 65536 + 0.5) AS BIGINT) % 65536 AS INT) AS angle,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576) ELSE printf('%.2f GiB', b / 1073741824) END AS bytes,
  substring(sha1(p_name || '|' || p_size), 1, 16) AS key, p_name AS decoded, 'file:///a%20b/' || replace(p_name, ' ', '%20') || '%2B%C3%BC%25.mp4' AS uri, '/a b/' || p_name || '+ü%.mp4' AS path,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS BIGINT) WHEN p_size % 3 = 1 THEN CAST(greatest(1, round(p_size * 0.25 * 30)) AS BIGINT) ELSE CAST(greatest(1, round(p_size * 0.25)) AS BIGINT) END AS eased,
  upper(lpad(to_hex(CAST(floor(p_size / 50 * 16777215 + 0.5) AS BIGINT)), 6, '0')) || '0000008000007FFFFF' AS rect
FROM (SELECT *, CAST(p_partkey AS BIGINT) * p_size * p_size * 7 AS b FROM part)""".replace("8000007FFFFF", "800000FFFFFF"))
def q_codes(spark, sf_dir):
    """Colours, angles, sizes, keys, URIs, base64, easing lengths and packed rectangles."""
    p = table(spark, sf_dir, "part")
    size, path = F.col("p_size"), F.concat(F.lit("/a b/"), F.col("p_name"), F.lit("+ü%.mp4"))
    coded = F.rtrim(F.translate(F.base64(F.col("p_name").cast("binary")), "+/", "-_"), F.lit("="))
    unit = F.when(size % 3 == 1, "sec").otherwise("f")
    uri = C.uri_of_path(path)
    return p.select(
        "p_partkey", C.hex_colour(size * 5, F.lit(16), F.col("p_partkey") % 256).alias("colour"), C.angle_code(size * 37 - 720).alias("angle"), C.byte_size(F.col("p_partkey").cast("long") * size * size * 7).alias("bytes"),
        C.cache_key(F.col("p_name"), size).alias("key"), C.base64url(coded).cast("string").alias("decoded"), uri.alias("uri"), C.path_of_uri(uri).alias("path"),
        C.ease_length(F.when(size % 3 != 0, size * 0.25), unit, F.col("p_partkey").cast("long"), 30.0).cast("long").alias("eased"),
        C.pack_rect(size / 50, F.lit(0.0), F.lit(0.5), F.lit(1.5)).alias("rect"),
    )


def _f32(x: str) -> str:
    return f"CAST(trunc(CAST({x} AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT)"


@query(Q._LEVELS + f""", d AS (SELECT src, frame, u16, list_filter([1, 2, 3, 4, 5], lambda k: {_f32("round(u16 / 65535 * 10 ** k) / 10 ** k")} = u16)[1] AS k FROM levels),
w AS (SELECT *, CAST(round(u16 / 65535 * 10 ** coalesce(k, 5)) AS BIGINT) AS w, CAST(10 ** coalesce(k, 5) AS BIGINT) AS s FROM d)
SELECT src, frame, CAST(w // s AS VARCHAR) || '.' || lpad(CAST(w % s AS VARCHAR), CAST(coalesce(k, 5) AS INT), '0') AS decimal, CAST(round((u16 / 32767.5 - 1) * 32767) AS INT) AS s16, CAST(floor(u16 / 65535 * 16777215 + 0.5) AS INT) AS u24,
  round(10 ** ((u16 / 1000 - 60) / 20), 9) AS gain, CASE WHEN u16 = 0 THEN -90.0 ELSE round(20 * log10(u16 / 65535), 9) END AS db, round(440 * 2 ** ((u16 % 128 - 69) / 12), 6) AS hertz FROM w""")
def q_level_values(spark, sf_dir):
    """Shortest decimals, 16 and 24 bits, gains, decibels and notes."""
    u = F.col("u16")
    return Q._levels(spark, sf_dir).select(
        "src", "frame", C.shortest_decimal(u).alias("decimal"), C.s16(u / 32767.5 - 1).alias("s16"), C.u24(C.u16_value(u)).alias("u24"),
        F.round(C.gain(u / 1000 - 60), 9).alias("gain"), F.round(C.decibels(C.u16_value(u)), 9).alias("db"), F.round(C.note_hertz(u % 128), 6).alias("hertz"),
    )


@query("""
WITH s AS (SELECT conv_id AS src, CAST(turn AS BIGINT) * 2500 AS a, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS t FROM conversations WHERE text IS NOT NULL)
SELECT src, a AS start_ms, a + 1700 AS end_ms, 'Hi, ' || regexp_replace(t, '\\{[^}]*\\}', '', 'g') || chr(10) || 'x y' AS text FROM s""")
def q_ass_read(spark, sf_dir):
    """SubStation files with styles, breaks and commas in their text, back to cues."""
    from framespan.sources.subtitles import read_ass

    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("src"), (F.col("turn").cast("long") * 2500).alias("a"), F.regexp_replace("text", r"[\r\n]+", " ").alias("t"))
    line = F.concat(F.lit("Dialogue: 0,"), C.timecode(F.col("a"), "ass"), F.lit(","), C.timecode(F.col("a") + 1700, "ass"), F.lit(r",Default,,0,0,0,,{\i1}Hi{\i0}, "), F.col("t"), F.lit(r"\Nx\hy"))
    files = rows.groupBy("src").agg(F.concat(F.lit("[Events]\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("content"))
    return read_ass(files)


@query(Q._CUES + """, clips AS (SELECT src, k * 300 AS "offset", 200 AS dur, k * 200 AS "start" FROM (SELECT src, unnest(generate_series(0, CAST((length - 1) // 300 AS BIGINT))) AS k FROM len)),
m AS (SELECT c.src, CAST(round((c."start" + greatest(c."offset", q.s) - c."offset") / 25.0 * 1000) AS BIGINT) AS a, CAST(round((c."start" + least(c."offset" + c.dur, q.s + q.dur) - c."offset") / 25.0 * 1000) AS BIGINT) AS b, q.text
  FROM clips c JOIN cues q ON c.src = q.src AND greatest(c."offset", q.s) < least(c."offset" + c.dur, q.s + q.dur)),
n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY a, b, text) AS n FROM m)
SELECT src, n, n || chr(10) || lpad(CAST(a // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') || ' --> '
  || lpad(CAST(b // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(b % 1000 AS VARCHAR), 3, '0') || chr(10) || text || chr(10) AS text FROM n""")
def q_retimed_subtitles(spark, sf_dir):
    from framespan.sinks.dumps import retimed_subtitles

    cues = A.conversation_cues(table(spark, sf_dir, "conversations")).where("text is not null")
    k = F.explode(F.sequence(F.lit(0).cast("long"), C.whole_div(F.col("length") - 1, 300)))
    clips = cues.groupBy("src").agg(F.max("end").alias("length")).select("src", k.alias("k")).select("src", (F.col("k") * 300).alias("offset"), F.lit(200).cast("long").alias("dur"), (F.col("k") * 200).alias("start"))
    return retimed_subtitles(cues, clips, 25.0)


def _media(spark, sf_dir) -> DataFrame:
    """Media with a video stream or none and up to three of sound, by part."""
    p = table(spark, sf_dir, "part")
    num = F.when(F.col("p_size") % 3 == 0, 30000).when(F.col("p_size") % 3 == 1, 25).otherwise(2997)
    den = F.when(F.col("p_size") % 3 == 0, 1001).when(F.col("p_size") % 3 == 1, 1).otherwise(100)
    video = F.struct(F.lit("h264").alias("codec"), num.alias("num"), den.alias("den"), F.lit("eng").alias("lang"))
    sound = F.struct(F.lit("aac").alias("codec"), F.lit(None).cast("string").alias("lang"))
    none = F.filter(F.array(video), lambda x: F.lit(False))
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.when(F.col("p_partkey") % 4 == 0, none).otherwise(F.array(video)).alias("v"), F.array_repeat(sound, (F.col("p_size") % 4).cast("int")).alias("a"), F.filter(F.array(sound), lambda x: F.lit(False)).alias("s"))


@query("""
WITH m AS (SELECT 'p' || p_partkey AS media, p_partkey, p_size FROM part),
s AS (SELECT media, 'v' AS kind, CAST(0 AS INT) AS layer FROM m WHERE p_partkey % 4 <> 0 UNION ALL SELECT media, 'a', CAST(unnest(generate_series(0, p_size % 4 - 1)) AS INT) FROM m WHERE p_size % 4 > 0)
SELECT media, ord, kind, layer, layer AS stream, CASE WHEN p_partkey % 4 = 0 THEN '30/1' WHEN p_size % 3 = 1 THEN '25/1' ELSE '30000/1001' END AS timebase
FROM (SELECT 'p' || l_partkey AS media, l_linenumber AS ord FROM lineitem) JOIN s USING (media) JOIN m USING (media)""")
def q_fan_out(spark, sf_dir):
    """Clips for every stream of their source, with its recommended rate."""
    from framespan.sources.media import fan_out, recommended_timebase

    media = _media(spark, sf_dir)
    clips = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("media"), F.col("l_linenumber").alias("ord"))
    return fan_out(clips, media).join(recommended_timebase(media).withColumnRenamed("path", "media"), "media").select("media", "ord", "kind", "layer", "stream", "timebase")


@query(Q._CLIPS.rstrip() + """, many AS (SELECT src, count(*) AS n FROM c GROUP BY src)
SELECT src, row_number() OVER (PARTITION BY src ORDER BY "start") AS part, CAST(0 AS BIGINT) AS "start", dur, "offset", 'm' || (ord % 2) || '#' || (ord % 3) AS media, CAST(0 AS INT) AS stream, CAST(48000 AS INT) AS samplerate, n > 2 AS linear FROM c JOIN many USING (src)""")
def q_per_clip(spark, sf_dir):
    """A timeline for each clip, on sources of one stream each, with settings replaced; and which timelines are linear."""
    own = Q._clips(spark, sf_dir)
    rows = own.withColumns({"media": F.concat(F.lit("m"), F.col("ord") % 2), "stream": (F.col("ord") % 3).cast("int"), "samplerate": F.lit(44100)})
    rows = timeline.retarget(timeline.one_stream_sources(timeline.per_clip(rows)), samplerate=48000)
    lines = timeline.is_linear(own.groupBy("src").agg(F.collect_list("ord").alias("o")).select(F.col("src").alias("tl"), F.when(F.size("o") > 2, F.col("o")).alias("clips2")))
    return rows.join(lines.withColumnRenamed("tl", "src"), "src").select("src", "part", "start", "dur", "offset", "media", "stream", "samplerate", "linear")


def _documented(spark, sf_dir) -> DataFrame:
    """Clips of both kinds, on two sources, a tenth of the orders to a timeline."""
    c = Q._clips(spark, sf_dir)
    rows = c.withColumn("media", F.concat(F.lit("/m/a "), F.col("ord") % 2, F.lit(".mp4"))).withColumn("speed", F.when(F.col("ord") % 3 == 0, 2.0).otherwise(1.0))
    kinds = F.explode(F.array(F.lit("v"), F.lit("a"))).alias("kind")
    return rows.select(F.col("src").cast("string").alias("src"), kinds, F.lit(0).alias("layer"), (F.col("ord") - 1).alias("ord"), "media", "start", "dur", "offset", "speed")


_DOCUMENTED = Q._CLIPS.rstrip() + """, x AS (SELECT CAST(src AS VARCHAR) AS src, kind, CAST(0 AS INT) AS layer, ord - 1 AS ord, '/m/a ' || (ord % 2) || '.mp4' AS media, "start", dur, "offset", CASE WHEN ord % 3 = 0 THEN 2.0 ELSE 1.0 END AS speed FROM c, (VALUES ('v'), ('a')) AS k(kind))"""


@query(_DOCUMENTED + """ SELECT src, kind, layer, ord, media, "start", dur, "offset", CASE WHEN speed = 2 THEN 'speed:2' ELSE '' END AS effects FROM x""")
def q_xmeml_round_trip(spark, sf_dir):
    """Timelines written as editor documents and read back."""
    from framespan.sinks import editors
    from framespan.sources import xmeml

    back = xmeml.read_xmeml(editors.documents(_documented(spark, sf_dir), None, "premiere", Fraction(30)))
    return back.select("src", "kind", "layer", "ord", "media", "start", "dur", "offset", F.array_join("effects", ",").alias("effects"))


@query(_DOCUMENTED + """ SELECT src, CAST(count(*) * 2 AS INT) AS items, CAST(2 AS INT) AS pairs, CAST(count(DISTINCT media) AS INT) AS files FROM x WHERE kind = 'a' GROUP BY src""")
def q_stereo_tracks(spark, sf_dir):
    """Sound of two channels as pairs of tracks in an editor document: items of sound, tracks of a pair, files."""
    from framespan.sinks import editors

    docs = editors.documents(_documented(spark, sf_dir), None, "premiere", Fraction(30), channels={"/m/a 0.mp4": 2, "/m/a 1.mp4": 2})
    sound = F.regexp_extract("document", r"(?s)<audio>(.*)</audio>", 1)
    return docs.select("src", F.regexp_count(sound, F.lit("<clipitem ")).alias("items"), F.regexp_count("document", F.lit("currentExplodedTrackIndex")).alias("pairs"), F.regexp_count("document", F.lit("<pathurl>")).alias("files"))


def _sum_of(column, pattern: str):
    return F.aggregate(F.transform(F.regexp_extract_all(column, F.lit(pattern), 1), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)


@query(_DOCUMENTED + """ SELECT src, CAST(count(*) AS INT) AS clips, CAST(sum(dur) AS BIGINT) AS dur, CAST(sum("offset") AS BIGINT) AS "offset", CAST(count(*) FILTER (speed = 2) AS INT) AS retimed FROM x WHERE kind = 'v' GROUP BY src""")
def q_fcpxml(spark, sf_dir):
    """Final Cut documents: clips of the spine, their durations and starts, and those with a time map."""
    from framespan.sinks import editors

    docs = editors.documents(_documented(spark, sf_dir), None, "final-cut-pro", Fraction(30))
    spine = F.regexp_extract("document", r"(?s)<spine>(.*)</spine>", 1)
    one = docs.select("src", spine.alias("s"))
    return one.select("src", F.regexp_count("s", F.lit("<asset-clip ")).alias("clips"), _sum_of("s", r'<asset-clip [^>]* duration="(\d+)(?:/30)?s"').alias("dur"), _sum_of("s", r'<asset-clip [^>]* start="(\d+)(?:/30)?s"').alias("offset"), F.regexp_count("s", F.lit("<timeMap>")).alias("retimed"))


def _milliseconds(digits: Column) -> Column:
    """Of a time hhmmssmmm, with any number of hours."""
    long = digits - C.whole_div(digits, 10_000_000) * 6_400_000 - C.whole_div(digits, 100_000) % 100 * 40_000
    return F.when(digits < 100_000, digits).otherwise(long)


def _entries(docs: DataFrame) -> DataFrame:
    """Entries of MLT documents (src, document), with the sums of their times: a document is searched once."""
    found = docs.select("src", F.regexp_extract_all("document", F.lit(r'<entry producer="[^"]*" in="([\d:.]+" out="[\d:.]+)"'), F.lit(1)).alias("e"))
    none = F.lit("")
    found = found.select("src", F.transform("e", lambda e: F.replace(F.replace(e, F.lit(":"), none), F.lit("."), none)).alias("e"))
    total = lambda side: F.aggregate(F.transform("e", lambda e: F.substring_index(e, '"', side).cast("long")), F.lit(0).cast("long"), lambda a, t: a + _milliseconds(t))
    return found.select("src", F.size("e").alias("entries"), total(1).alias("in_ms"), total(-1).alias("out_ms"))


def _mlt(spark, sf_dir, kind: str) -> DataFrame:
    from framespan.sinks import editors

    return _entries(editors.documents(_documented(spark, sf_dir), None, kind, Fraction(25)))


_ENTRIES = _DOCUMENTED + """ SELECT src, CAST(count(*) AS INT) AS entries, CAST(sum("offset" * 40) AS BIGINT) AS in_ms, CAST(sum(("offset" + dur - 1) * 40) AS BIGINT) AS out_ms FROM x GROUP BY src"""


@query(_ENTRIES)
def q_shotcut(spark, sf_dir):
    """MLT documents of the first flavour: entries of their playlists, from and to which time."""
    return _mlt(spark, sf_dir, "shotcut")


@query(_ENTRIES)
def q_kdenlive(spark, sf_dir):
    """MLT documents of the second flavour."""
    return _mlt(spark, sf_dir, "kdenlive")


@query(_DOCUMENTED + """ SELECT src, CAST(count(*) AS INT) AS clips, CAST(sum(dur) AS BIGINT) AS dur, CAST(count(*) FILTER (speed = 2) AS INT) AS retimed FROM x WHERE kind = 'v' GROUP BY src""")
def q_otio(spark, sf_dir):
    """OpenTimelineIO documents: clips of the first track with their durations."""
    from framespan.sinks import editors

    docs = editors.documents(_documented(spark, sf_dir), None, "otio", Fraction(30))
    shape = "struct<tracks:struct<children:array<struct<children:array<struct<OTIO_SCHEMA:string,source_range:struct<duration:struct<value:double>>,effects:array<struct<OTIO_SCHEMA:string>>>>>>>>"
    track = F.from_json("document", shape)["tracks"]["children"][0]["children"]
    clips = docs.select("src", F.filter(track, lambda c: c["OTIO_SCHEMA"] == "Clip.2").alias("c"))
    dur = F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["source_range"]["duration"]["value"].cast("long"))
    return clips.select("src", F.size("c").alias("clips"), dur.alias("dur"), F.size(F.filter("c", lambda c: F.size(c["effects"]) > 0)).alias("retimed"))


_PICTURES = Q._PIXELS + """,
m AS (SELECT idx, list_transform(generate_series(0, 7), lambda y: px[y * 8 + 1:y * 8 + 8]) AS m FROM f),
p AS (SELECT idx, CAST(y AS INT) AS y, CAST(x AS INT) AS x, m[y + 1][x + 1] AS p FROM m, generate_series(0, 7) AS a(y), generate_series(0, 7) AS b(x)),
e AS (SELECT a.idx, a.y, a.x, min(b.p) AS v FROM p a JOIN p b ON a.idx = b.idx AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
g AS (SELECT p.idx, p.y, p.x, p.p, q.v AS mosaic, e.v AS eroded FROM p JOIN (SELECT idx, y // 3 AS by, x // 3 AS bx, round(avg(p)) AS v FROM p GROUP BY ALL) q ON q.idx = p.idx AND q.by = p.y // 3 AND q.bx = p.x // 3 JOIN e ON e.idx = p.idx AND e.y = p.y AND e.x = p.x),
r AS (SELECT g.*, h.p AS mirrored, v.p AS upside, s.p AS smeared, w.p AS wrapped FROM g JOIN p h ON h.idx = g.idx AND h.y = g.y AND h.x = 7 - g.x JOIN p v ON v.idx = g.idx AND v.y = 7 - g.y AND v.x = g.x
  JOIN p s ON s.idx = g.idx AND s.y = least(greatest(g.y - 1, 0), 7) AND s.x = least(greatest(g.x - 2, 0), 7) JOIN p w ON w.idx = g.idx AND w.y = (g.y + 7) % 8 AND w.x = (g.x + 6) % 8),
k AS (SELECT *, (y * 8 + x) % 97 + 1 AS k FROM r)"""


def _clamped(x: str) -> str:
    return f"least(greatest(round({x}), 0), 255)"


@query(_PICTURES + f"""
SELECT idx, CAST(sum(k * mirrored) AS BIGINT) AS hflip, CAST(sum(k * upside) AS BIGINT) AS vflip, CAST(sum(k * eroded) AS BIGINT) AS erosion, CAST(sum(k * mosaic) AS BIGINT) AS mosaic, CAST(sum(k * smeared) AS BIGINT) AS smeared, CAST(sum(k * wrapped) AS BIGINT) AS wrapped,
  CAST(sum(k * CASE WHEN x >= 2 AND x < 5 AND y >= 1 AND y < 7 THEN 200 ELSE p END) AS BIGINT) AS box, CAST(sum(k * {_clamped("p * (idx % 10 / 10) + 16 * (1 - idx % 10 / 10)")}) AS BIGINT) AS opacity,
  CAST(sum(k * {_clamped("(p - 128) * 1.5 + 128 + 0.1 * 255")}) AS BIGINT) AS luma, CAST(sum(k * {_clamped("(p - 128) * 0.5 + 128")}) AS BIGINT) AS chroma, CAST(sum(k * CASE WHEN abs(p - 120) <= 0.05 * 255 THEN 0 ELSE p END) AS BIGINT) AS keyed FROM k GROUP BY idx""")
def q_pictures(spark, sf_dir):
    """Actions on pictures of 8 by 8 pixels."""
    f = A.embedding_frames(table(spark, sf_dir, "embeddings")).select("idx", pictures.picture(F.col("px"), 8).alias("m"))
    m = F.col("m")
    made = {
        "hflip": pictures.hflip(m), "vflip": pictures.vflip(m), "erosion": pictures.erosion(m), "mosaic": pictures.mosaic(m, 3, 3), "smeared": pictures.shifted(m, 2, 1), "wrapped": pictures.shifted(m, 2, 1, True),
        "box": pictures.drawbox(m, 2, 1, 3, 6, 200), "opacity": pictures.opacity(m, F.col("idx") % 10 / 10, 16), "luma": pictures.luma(m, 0.1, 1.5), "chroma": pictures.chroma(m, 0.5), "keyed": pictures.key_out(m, 120, 0.05),
    }
    return f.select("idx", *(pictures.checksum(v).alias(k) for k, v in made.items()))


@query(Q._PIXELS + """,
a AS (SELECT idx, list_transform(px, lambda p: CAST(round((p - 128) * 300) AS INT)) AS s, px FROM f)
SELECT idx, list_sum(list_transform(s, lambda v: least(greatest(round(v * 0.7), -32768), 32767)))::BIGINT AS volume, idx % 50 AS looped, list_sum(list_transform(px, lambda p: CASE WHEN abs(p - 128) <= 12.75 THEN 0 ELSE p END))::BIGINT AS keyed,
  px[1]::INT AS first, round((px[3] * (1 - px[1] / 255) + px[2] * px[1] / 255))::INT AS over FROM a""")
def q_sound_kernels(spark, sf_dir):
    """Volume on samples, looping, keys and overlays on lines."""
    px = F.col("px")
    f = A.embedding_frames(table(spark, sf_dir, "embeddings"))
    samples = F.transform(px, lambda p: ((p - 128) * 300).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    over = K.overlay(px, F.slice(px, 2, 1), F.slice(px, 1, 1), 2)
    return f.select("idx", total(K.volume(samples, 0.7)).alias("volume"), K.loop_index(F.col("idx"), F.lit(50)).alias("looped"), total(K.key_out(px, 128, 0.05)).alias("keyed"), px[0].alias("first"), over[2].alias("over"))


@query("""
WITH n AS (SELECT DISTINCT CAST(l_linenumber AS INT) AS n FROM lineitem), k AS (SELECT n, unnest(generate_series(0, 99)) AS k FROM n),
t AS (SELECT n, CAST(sum(CAST(round(sin(k * (440 * 2 ** ((n + 60 - 69) / 12.0)) * 2 * pi() / 8000) * 8191) AS BIGINT) * (k + 1)) AS BIGINT) AS tone FROM k GROUP BY n),
m AS (SELECT n, CAST(sum(CASE WHEN x >= 2 AND x < 2 + n AND y >= 1 AND y < 4 THEN 255 ELSE 0 END) AS BIGINT) AS matte FROM n, generate_series(0, 15) AS a(x), generate_series(0, 8) AS b(y) GROUP BY n)
SELECT n, tone, matte FROM t JOIN m USING (n)""")
def q_generators(spark, sf_dir):
    """Tones and mattes."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("n")).distinct()
    tone = K.tone(F.col("n") + 60, F.lit(100), 8000)
    weighed = F.aggregate(F.transform(tone, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    matte = F.lit(None).cast("long")
    for w in range(1, 8):  # the shape of a matte is known when the plan is made
        own = F.aggregate(F.flatten(K.matte(16, 9, 2, 1, w, 3)), F.lit(0).cast("long"), lambda a, v: a + v)
        matte = F.when(F.col("n") == w, own).otherwise(matte)
    return n.select("n", weighed.alias("tone"), matte.alias("matte"))


@query(Q._CLIPS.rstrip() + """, s AS (SELECT src, ord, dur, unnest(generate_series(0, dur - 1)) AS local FROM c),
t AS (SELECT src, ord, local, (local * 7919 + ord * 1009) % 65536 - 32768 AS v, least(local / (20 - 1), 1.0) AS t FROM s),
e AS (SELECT src, ord, local, v, 2 * (t * t) AS x FROM t)
SELECT src, ord, local, CAST(least(greatest(round(v * CASE WHEN x >= 2 THEN 3.0 WHEN x < 1 THEN 0.0 + 0.5 * x ELSE 0.5 + 2.5 * (x - 1) END), -32768), 32767) AS INT) AS v FROM e""")
def q_keyframed_volume(spark, sf_dir):
    """A volume of 0..0.5..3 that eases in over 20 samples and then holds, on samples of all clips."""
    c = Q._clips(spark, sf_dir)
    samples = c.select("src", "ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dur") - 1)).alias("local"))
    samples = samples.withColumn("v", (F.col("local") * 7919 + F.col("ord") * 1009) % 65536 - 32768)
    return mixing.keyframed_volume(samples, c, [0.0, 0.5, 3.0], "in", 20)


@query(Q._LAYERS + """SELECT src, layer, ord, "start", row_number() OVER (PARTITION BY src ORDER BY "start", layer, ord) - 1 AS place FROM l""")
def q_merge_order(spark, sf_dir):
    return timeline.merge_order(Q._layers(spark, sf_dir)).select("src", "layer", "ord", "start", "place")


@query("""
WITH l AS (SELECT l_orderkey AS src, CAST(l_linenumber AS INT) AS layer, max(CAST(l_quantity AS INT) % 4) AS channels FROM lineitem GROUP BY ALL),
o AS (SELECT src, layer, greatest(channels, 1) AS channels, coalesce(sum(greatest(channels, 1)) OVER (PARTITION BY src ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l)
SELECT src, layer, CAST(e AS INT) AS exploded, CAST(below + e + 1 AS BIGINT) AS track FROM o, generate_series(0, 1) AS t(e) WHERE e < channels""")
def q_audio_tracks(spark, sf_dir):
    layers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_linenumber").cast("int").alias("layer")).agg(F.max(F.col("l_quantity").cast("int") % 4).alias("channels"))
    return timeline.audio_tracks(layers)


@query("""
WITH a AS (SELECT DISTINCT CAST(l_linenumber AS INT) AS n FROM lineitem)
SELECT n, 'filters speed:' || (n + 1) || '|volume volume:0.5|filters pitch:3,varispeed:1.5|volume volume:0.' || n AS stages, 'invert|blur:4 in confine:' || n || ':2:3:4:0:0|hflip in confine:' || n || ':2:3:4:0:0|vflip' AS confined FROM a""")
def q_action_chains(spark, sf_dir):
    """The stages of a clip's sound, parted at each volume, and the regions that actions are confined to."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("n")).distinct()

    def read(t: str) -> dict:
        stages = chain.audio_stages(P.parse_list(f"speed:{int(t) + 1},invert,volume:0.5,pitch:3,varispeed:1.5,volume:0.{t}"))
        regions = chain.confined(P.parse_list(f"invert,confine:{t}:2:3:4,blur:4,hflip,confine,vflip"))
        return {"stages": "|".join(f"{name} {','.join(map(str, own))}" for name, own in stages), "confined": "|".join(str(a) + (f" in {r}" if r else "") for a, r in regions)}

    return _by_text(n.withColumn("t", F.col("n").cast("string")), "stages string, confined string", read).select("n", "out.*")
