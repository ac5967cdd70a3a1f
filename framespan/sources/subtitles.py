"""Cues from SubRip and Advanced SubStation texts, and the choice of a sidecar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions.columns import dialogue_text


def _ms(h: Column, m: Column, s: Column, rest: Column, unit: int) -> Column:
    return ((h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")) * 1000 + rest.cast("long") * unit


def read_srt(files: DataFrame, content: str = "content") -> DataFrame:
    """Cues (src, start_ms, end_ms, text) of SubRip files (src, content); blocks without a time are skipped."""
    blocks = files.select("src", F.explode(F.split(F.regexp_replace(F.col(content).cast("string"), "\r\n?", "\n"), r"\n\s*\n")).alias("b"))
    time = r"(?s)^\s*(?:\d+\s*\n)?\s*(\d+):(\d+):(\d+)[,.](\d{3})\s*-->\s*(\d+):(\d+):(\d+)[,.](\d{3})[^\n]*\n?(.*)$"
    g = [F.regexp_extract("b", time, k) for k in range(1, 10)]
    rows = blocks.where(F.col("b").rlike(time)).select("src", _ms(*g[0:4], 1).alias("start_ms"), _ms(*g[4:8], 1).alias("end_ms"), F.regexp_replace(g[8], r"^\s+|\s+$", "").alias("text"))
    return rows.where("end_ms > start_ms")


def read_ass(files: DataFrame, content: str = "content") -> DataFrame:
    """Cues (src, start_ms, end_ms, text) of the dialogue lines of SubStation files, as plain text."""
    lines = files.select("src", F.explode(F.split(F.col(content).cast("string"), r"\r?\n")).alias("line")).where("line like 'Dialogue:%'")
    time = r"^Dialogue:\s*[^,]*,\s*(\d+):(\d+):(\d+)\.(\d{2}),\s*(\d+):(\d+):(\d+)\.(\d{2}),(.*)$"
    g = [F.regexp_extract("line", time, k) for k in range(1, 10)]
    # The event as decoders give it: order and layer stand where the two times were.
    event = F.concat(F.lit("0,0,"), g[8])
    rows = lines.where(F.col("line").rlike(time)).select("src", _ms(*g[0:4], 10).alias("start_ms"), _ms(*g[4:8], 10).alias("end_ms"), dialogue_text(event).alias("text"))
    return rows.where("end_ms > start_ms")


def with_sidecars(cues: DataFrame, streams: DataFrame, sidecars: DataFrame, stream: int) -> DataFrame:
    """Cues of a stream: the container's own if it has so many, else those of the sidecar with what is left of the number.

    ``cues`` are (src, stream, ...), ``streams`` (src, n), ``sidecars`` (src, stream, ...).
    """
    own = cues.where(F.col("stream") == stream).drop("stream")
    lacking = streams.where(F.col("n") <= stream).select("src", (F.lit(stream) - F.col("n")).alias("stream"))
    return own.unionByName(sidecars.join(lacking, ["src", "stream"]).drop("stream"))


def cues_in_frames(cues: DataFrame, frames_per_second: float) -> DataFrame:
    """Cues (src, start, end, text) in frames, not rounded."""
    at = lambda c: F.col(c) / 1000 * frames_per_second
    return cues.select("src", at("start_ms").alias("start"), at("end_ms").alias("end"), "text")
