"""Timelines read from JSON: v1, v2, v3, by their version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import clip_bounds
from framespan.operators.timeline import before, speed_product

CUT_SPEED = 99999.0
_V1 = "struct<version:string,source:string,timebase:string,chunks:array<array<double>>>"
_V2 = "struct<version:string,source:string,tb:string,effects:array<array<string>>,clips:array<array<bigint>>>"
_CLIP = "struct<src:string,start:bigint,dur:bigint,offset:bigint,stream:int,effects:array<string>>"
_V3 = f"struct<version:string,timebase:string,background:string,resolution:array<int>,samplerate:int,layout:string,v:array<array<{_CLIP}>>,a:array<array<{_CLIP}>>,transitions:struct<v:array<array<struct<kind:string,at:bigint,dur:bigint,alignment:string>>>,a:array<array<struct<kind:string,at:bigint,dur:bigint,alignment:string>>>>>"


def version(text):
    """The version a document says it has."""
    return F.get_json_object(text, "$.version")


def _checked(value, ok, problem: str):
    return F.when(ok, value).otherwise(F.raise_error(F.lit(problem)))


def read_v1(documents: DataFrame, column: str) -> DataFrame:
    """Clips (src, ord, start, dur, offset, speed) of v1 documents: cut chunks and those that round to nothing are left out."""
    parsed = documents.select("src", F.from_json(column, _V1).alias("d"))
    rows = parsed.select("src", F.posexplode("d.chunks").alias("n", "c"))
    rows = rows.select("src", "n", _checked(F.col("c"), F.size("c") == 3, "a chunk needs three numbers").alias("c"))
    rows = rows.select("src", "n", F.col("c")[0].cast("long").alias("a"), F.col("c")[1].cast("long").alias("b"), F.col("c")[2].alias("speed"))
    rows = rows.where((F.col("speed") > 0) & (F.col("speed") < CUT_SPEED))
    offset, dur = clip_bounds(F.col("a"), F.col("b"), F.col("speed"))
    kept = rows.select("src", "n", offset.alias("offset"), dur.alias("dur"), "speed").where("dur > 0")
    order = Window.partitionBy("src").orderBy("n")
    return kept.select("src", (F.row_number().over(order) - 1).cast("long").alias("ord"), before("dur", "src", order=("n",)).alias("start"), "dur", "offset", "speed")


def read_v2(documents: DataFrame, column: str) -> DataFrame:
    """Clips (src, ord, start, dur, offset, effects, actions) of v2 documents; equal lists of effects get one number.

    A clip whose list cuts is left out of the timeline.
    """
    parsed = documents.select("src", F.from_json(column, _V2).alias("d"))
    rows = parsed.select("src", "d.effects", F.posexplode("d.clips").alias("n", "c"))
    rows = rows.select("src", "n", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), F.get("effects", F.col("c")[2].cast("int")).alias("actions"))
    rows = rows.where(~F.array_contains(F.coalesce("actions", F.array().cast("array<string>")), "cut"))
    speeds = F.transform(F.filter("actions", lambda x: x.rlike("^(vari)?speed:")), lambda x: F.substring_index(x, ":", -1).cast("double"))
    rows = rows.withColumn("speed", speed_product(speeds))
    offset, dur = clip_bounds(F.col("a"), F.col("b"), F.col("speed"))
    kept = rows.select("src", "n", offset.alias("offset"), dur.alias("dur"), "actions", F.to_json("actions").alias("grp")).where("dur > 0")
    from framespan.operators.timeline import dense_effects

    numbered = dense_effects(kept, "grp", "n", "src")
    order = Window.partitionBy("src").orderBy("n")
    return numbered.select("src", (F.row_number().over(order) - 1).cast("long").alias("ord"), before("dur", "src", order=("n",)).alias("start"), "dur", "offset", "effects", "actions")


def read_v3(documents: DataFrame, column: str) -> DataFrame:
    """Clips (src, kind, layer, ord, media, start, dur, offset, stream, effects) of v3 documents, checked."""
    parsed = documents.select("src", F.from_json(column, _V3).alias("d"))
    kinds = [parsed.select("src", F.lit(k).alias("kind"), F.posexplode(f"d.{k}").alias("layer", "track")) for k in ("v", "a")]
    rows = kinds[0].union(kinds[1]).select("src", "kind", "layer", F.posexplode("track").alias("ord", "c"))
    good = (F.col("c.start") >= 0) & (F.col("c.dur") > 0) & (F.col("c.offset") >= 0)
    rows = rows.select("src", "kind", "layer", F.col("ord").cast("long").alias("ord"), _checked(F.col("c"), F.coalesce(good, F.lit(False)), "a clip needs a start, a positive dur and an offset").alias("c"))
    return rows.select("src", "kind", "layer", "ord", F.col("c.src").alias("media"), "c.start", "c.dur", "c.offset", "c.stream", "c.effects")


def read_transitions(documents: DataFrame, column: str) -> DataFrame:
    """Transitions (src, kind, layer, ord, at, dur, alignment) of v3 documents."""
    parsed = documents.select("src", F.from_json(column, _V3).alias("d"))
    kinds = [parsed.select("src", F.lit(k).alias("kind"), F.posexplode(f"d.transitions.{k}").alias("layer", "track")) for k in ("v", "a")]
    rows = kinds[0].union(kinds[1]).select("src", "kind", "layer", F.posexplode("track").alias("ord", "t"))
    return rows.select("src", "kind", "layer", F.col("ord").cast("long").alias("ord"), "t.at", "t.dur", "t.alignment")
