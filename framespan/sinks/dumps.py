"""Text forms: level and waveform dumps, transcripts, subtitles, one output per clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import shortest_decimal, timecode


def level_lines(levels: DataFrame, raw: bool = False) -> DataFrame:
    """(src, line, text) of a level series: ``@start``, a value a line (whole numbers if ``raw``), and an empty line."""
    text = F.col("u16").cast("string") if raw else shortest_decimal(F.col("u16"))
    body = levels.select("src", (F.col("frame") + 1).cast("long").alias("line"), text.alias("text"))
    ends = levels.groupBy("src").agg((F.max("frame") + 2).cast("long").alias("line"))
    heads = ends.select("src", F.lit(0).cast("long").alias("line"), F.lit("@start").alias("text"))
    return body.union(heads).union(ends.select("src", "line", F.lit("").alias("text")))


def waveform_lines(buckets: DataFrame, offset: int = 0) -> DataFrame:
    """(src, line, text) of a waveform: ``@start``, ``@offset N``, then ``lo,hi`` for each bucket."""
    order = Window.partitionBy("src").orderBy("bucket_start")
    body = buckets.select("src", (F.row_number().over(order) + 1).cast("long").alias("line"), F.concat_ws(",", F.round("lo").cast("long"), F.round("hi").cast("long")).alias("text"))
    heads = buckets.select("src").distinct().select("src", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit("@start").alias("text")), F.struct(F.lit(1).cast("long").alias("line"), F.lit(f"@offset {offset}").alias("text")))).alias("h"))
    return body.union(heads.select("src", "h.line", "h.text"))


def clean_transcript(segments: DataFrame) -> DataFrame:
    """Segments (src, start_ms, end_ms, text) without markers of silence and without what is then empty."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"\[BLANK_AUDIO\]", ""), r"\s+", " "))
    return segments.withColumn("text", text).where("text <> ''")


def transcript(segments: DataFrame, style: str = "text") -> DataFrame:
    """(src, n, text) of a transcript as plain lines, SubRip blocks (srt) or JSON lines (json)."""
    order = Window.partitionBy("src").orderBy("start_ms", "end_ms", "text")
    rows = segments.withColumn("n", F.row_number().over(order).cast("long"))
    if style == "srt":
        text = F.concat(F.col("n").cast("string"), F.lit("\n"), timecode(F.col("start_ms"), "srt"), F.lit(" --> "), timecode(F.col("end_ms"), "srt"), F.lit("\n"), F.col("text"), F.lit("\n"))
    elif style == "json":
        text = F.to_json(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "text"))
    else:
        text = F.col("text")
    return rows.select("src", "n", text.alias("text"))


def cue_json(cues: DataFrame) -> DataFrame:
    """(src, json) with all cues of each source in order of time."""
    return cues.groupBy("src").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start", "end", "text")))).alias("json"))


def retimed_subtitles(cues: DataFrame, clips: DataFrame, frames_per_second: float) -> DataFrame:
    """SubRip blocks of cues, in frames, as they stand on the timeline of clips."""
    from framespan.operators.masks import cue_overlaps

    moved = cue_overlaps(cues, clips)
    ms = lambda c: F.round(F.col(c) / frames_per_second * 1000).cast("long")
    return transcript(moved.select("src", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "text"), "srt")


def altered_name(path: str) -> str:
    """The name of a sidecar that was retimed."""
    stem, dot, extension = path.rpartition(".")
    return f"{stem}_ALTERED{dot}{extension}" if dot else f"{path}_ALTERED"


def clip_sequence(clips: DataFrame, path: str) -> None:
    """Write each clip of a single source to a folder of its own."""
    numbered = clips.withColumn("clip", F.row_number().over(Window.partitionBy("src").orderBy("start")))
    numbered.write.partitionBy("clip").mode("overwrite").parquet(path)


def keep_newest(cache: DataFrame, most: int = 255) -> DataFrame:
    """Cache entries (path, mtime) beyond the newest ``most``: those to delete, oldest first.

    Only the newest are gathered; equal entries are counted, so that as many stay as are among the newest.
    """
    newest = cache.orderBy(F.desc("mtime"), "path").limit(most).groupBy("path", "mtime").agg(F.count("*").alias("kept"))
    entries = cache.groupBy("path", "mtime").agg(F.count("*").alias("n"))
    both = entries.alias("e").join(F.broadcast(newest.alias("k")), F.expr("e.path <=> k.path and e.mtime <=> k.mtime"), "left")
    left = both.select("e.path", "e.mtime", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("left")).where("left > 0")
    return left.select("path", "mtime", F.explode(F.sequence(F.lit(1).cast("long"), "left"))).select("path", "mtime").orderBy("mtime", "path")
