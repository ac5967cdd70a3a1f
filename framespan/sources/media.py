"""Media metadata as nested rows, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, duration double, bitrate long, v array<struct<codec:string,num:int,den:int,width:int,height:int,duration:double,lang:string>>, "
    "a array<struct<codec:string,layout:string,rate:int,channels:int,duration:double,lang:string>>, s array<struct<codec:string,lang:string>>, d array<struct<codec:string>>, i array<struct<codec:string>>"
)


def streams(media: DataFrame) -> DataFrame:
    """One row per stream: path, kind, stream, codec, lang."""
    kinds = []
    for k in ("v", "a", "s"):
        row = media.select("path", F.lit(k).alias("kind"), F.posexplode(k).alias("stream", "x"))
        kinds.append(row.select("path", "kind", "stream", F.col("x.codec").alias("codec"), F.coalesce("x.lang", F.lit("und")).alias("lang")))
    return kinds[0].union(kinds[1]).union(kinds[2])


def recommended_timebase(media: DataFrame) -> DataFrame:
    """Rate of the first video stream (30 where there is none), snapped to an NTSC one that it equals at two decimals."""
    num, den = F.coalesce(F.get("v", F.lit(0))["num"], F.lit(30)), F.coalesce(F.get("v", F.lit(0))["den"], F.lit(1))
    rate = F.round(num / den, 2)
    out = F.concat_ws("/", num.cast("string"), den.cast("string"))
    for n in (60000, 30000, 24000):
        out = F.when(rate == round(n / 1001, 2), F.lit(f"{n}/1001")).otherwise(out)
    return media.select("path", out.alias("timebase"))


def fan_out(clips: DataFrame, media: DataFrame) -> DataFrame:
    """Each clip (media, ...) once for every video and audio stream of its source, as layers by kind and number."""
    s = streams(media).where("kind in ('v', 'a')").select(F.col("path").alias("media"), "kind", F.col("stream").alias("layer"))
    return clips.join(s, "media").withColumn("stream", F.col("layer"))


def nearest_rate(rate, supported: tuple[int, ...] = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000)):
    """The supported sample rate closest to one, the lower of two."""
    return F.array_min(F.transform(F.array(*map(F.lit, supported)), lambda r: F.struct(F.abs(r - rate).alias("d"), r.alias("r"))))["r"]


def info_json(media: DataFrame, **options) -> DataFrame:
    """(path, json) of the metadata of each file."""
    return media.join(recommended_timebase(media), "path").select("path", F.to_json(F.struct(F.col("timebase").alias("recommendedTimebase"), F.col("v").alias("video"), F.col("a").alias("audio"), F.col("s").alias("subtitle"), F.struct("duration", "bitrate").alias("container"))).alias("json"))


def level_cache_path(root: str, parts: tuple[str, ...], kind: str) -> str:
    """Where the levels of an analysis are kept: a key over what they depend on."""
    import hashlib

    return f"{root}/{hashlib.sha1('|'.join(parts).encode()).hexdigest()[:16]}-{kind}.parquet"


def cached_levels(spark, path: str, make) -> DataFrame:
    """Levels read from the cache; made and kept there if they aren't, unless they are ten rows or fewer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        made = make()
        if len(made.take(11)) <= 10:
            return made
        made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
