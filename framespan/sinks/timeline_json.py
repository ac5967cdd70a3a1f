"""Timelines as JSON: v1 (chunks), v2 (clips with an effects table), v3 (nested tracks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT_SPEED = 99999.0


def _sorted(struct: Column) -> Column:
    """The structs of a group as an array in order of their first fields."""
    return F.array_sort(F.collect_list(struct))


def v1_chunks(chunks: DataFrame) -> DataFrame:
    """One row per source with its chunks (start, end, speed); a null speed is a cut."""
    speed = F.coalesce(F.col("speed").cast("double"), F.lit(CUT_SPEED))
    return chunks.groupBy("src").agg(_sorted(F.struct("start", "end", speed.alias("speed"))).alias("chunks"))


def v1_json(chunks: DataFrame, timebase: str) -> DataFrame:
    """(src, json): chunks as arrays of three numbers."""
    arrays = F.transform("chunks", lambda c: F.array(c["start"].cast("double"), c["end"].cast("double"), c["speed"]))
    text = F.to_json(F.struct(F.lit("1").alias("version"), F.col("src").alias("source"), F.lit(timebase).alias("timebase"), arrays.alias("chunks")))
    return v1_chunks(chunks).select("src", text.alias("json"))


def v2_json(clips: DataFrame, timebase: str) -> DataFrame:
    """(src, json) of clips (src, start, end, effects array): each distinct list of effects is stored once, numbered by where it first occurs."""
    keyed = clips.withColumnRenamed("effects", "list").withColumn("grp", F.to_json("list"))
    from framespan.operators.timeline import dense_effects

    numbered = dense_effects(keyed, "grp", "start", "src")
    rows = numbered.groupBy("src").agg(_sorted(F.struct("start", "end", F.col("effects").alias("e"))).alias("c"))
    table = dense_effects(keyed.select("src", "grp", "start", "list"), "grp", "start", "src").groupBy("src", "effects").agg(F.first("list").alias("list"))
    table = table.groupBy("src").agg(F.transform(_sorted(F.struct("effects", "list")), lambda x: x["list"]).alias("effects"))
    arrays = F.transform("c", lambda c: F.array(c["start"].cast("long"), c["end"].cast("long"), c["e"].cast("long")))
    text = F.to_json(F.struct(F.lit("2").alias("version"), F.col("src").alias("source"), F.lit(timebase).alias("tb"), "effects", arrays.alias("clips")))
    return rows.join(table, "src").select("src", text.alias("json"))


def v3_json(clips: DataFrame, timebase: str, resolution: tuple[int, int] = (1920, 1080), samplerate: int = 48000, background: str = "#000000", transitions: DataFrame | None = None) -> DataFrame:
    """(src, json) of clips (src, kind v or a, layer, ord, start, dur, offset, stream, effects), nested as tracks of clips.

    Optional transitions are (src, kind, layer, at, dur, alignment).
    """
    clip = F.struct("start", "dur", "offset", "stream", "effects", F.col("src").alias("src"))
    tracks = clips.groupBy("src", "kind", "layer").agg(_sorted(clip).alias("clips"))
    nested = tracks.groupBy("src").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("layer", "clips")))), lambda t: t["clips"]).alias(k) for k in ("v", "a")))
    fields = [
        F.lit("3").alias("version"), F.lit(timebase).alias("timebase"), F.lit(background).alias("background"), F.array(*map(F.lit, resolution)).alias("resolution"),
        F.lit(samplerate).alias("samplerate"), F.lit("stereo").alias("layout"), F.col("v"), F.col("a"),
    ]
    if transitions is not None:
        t = transitions.groupBy("src", "kind", "layer").agg(_sorted(F.struct("at", "dur", "alignment", F.lit("dissolve").alias("kind"))).alias("t"))
        t = t.groupBy("src").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("layer", "t")))), lambda x: x["t"]).alias(f"t{k}") for k in ("v", "a")))
        nested = nested.join(t, "src", "left")
        fields.append(F.struct(F.col("tv").alias("v"), F.col("ta").alias("a")).alias("transitions"))
    return nested.select("src", F.to_json(F.struct(*fields)).alias("json"))
