"""Which parts of a source can be copied, and whether that is worth it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import whole_div

#: Frames of the blocks by which groups of pictures and clips meet.
BLOCK = 512


def picture_groups(keyframes: DataFrame, ends: DataFrame) -> DataFrame:
    """Groups (src, frame, group_end, final, source_end): from a keyframe to the next, or to the source's end."""
    w = Window.partitionBy("src").orderBy("frame")
    nexts = keyframes.select("src", "frame").distinct().select("src", "frame", F.lead("frame").over(w).alias("next"))
    return nexts.join(ends, "src").select("src", "frame", F.coalesce("next", "source_end").alias("group_end"), F.col("next").isNull().alias("final"), "source_end")


def render_plan(clips: DataFrame, groups: DataFrame) -> DataFrame:
    """Spans (src, n, kind, src_start, src_end, out_start): whole ``picture_groups`` inside a clip are copied, the rest is encoded.

    Spans that continue each other, in source and output, are one. A clip that wants more
    than the source has may not copy the last group. Clips and groups meet once; the spans of
    a clip follow from one window over what it copies and a mark at its end.
    """
    c = clips.select("src", "ord", "start", "offset", (F.col("offset") + F.col("dur")).alias("stop"))
    blocks = c.where("stop > offset").withColumn("block", F.explode(F.sequence(whole_div(F.col("offset"), BLOCK), whole_div(F.col("stop") - 1, BLOCK))))
    met = blocks.join(groups.withColumn("block", whole_div(F.col("frame"), BLOCK)), ["src", "block"])
    inside = met.where("frame >= offset and group_end <= stop and group_end > frame and not (final and stop > source_end)")
    ends = c.select("src", "ord", "start", "offset", F.col("stop").alias("a"), F.lit(None).cast("long").alias("b"))
    rows = inside.select("src", "ord", "start", "offset", F.col("frame").alias("a"), F.col("group_end").alias("b")).union(ends)
    w = Window.partitionBy("src").orderBy("ord", F.col("b").isNull(), "a")
    reach = F.when(F.lag("ord").over(w) == F.col("ord"), F.lag("b").over(w))
    rows = rows.withColumn("x", F.coalesce(reach, F.col("offset")))
    span = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("x"), high.alias("y"), (F.col("start") + low - F.col("offset")).alias("o"))
    each = F.filter(F.array(span("encode", F.col("x"), F.col("a")), span("copy", F.col("a"), F.col("b"))), lambda s: s["y"] > s["x"])
    spans = rows.select("src", "ord", F.inline(each))
    order = Window.partitionBy("src").orderBy("ord", "x")
    goes_on = (F.lag("kind").over(order) == F.col("kind")) & (F.lag("y").over(order) == F.col("x")) & (F.lag(F.col("o") + F.col("y") - F.col("x")).over(order) == F.col("o"))
    marked = spans.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("n", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy("src", "n").agg(F.first("kind").alias("kind"), F.min("x").alias("src_start"), F.max("y").alias("src_end"), F.min("o").alias("out_start"))


def plan_statistics(spans: DataFrame) -> DataFrame:
    """Per source: frames copied and encoded, spans of either, and runs of encoding."""
    before = F.lag("kind").over(Window.partitionBy("src").orderBy("n"))
    length = F.col("src_end") - F.col("src_start")
    s = spans.select("src", "kind", length.alias("frames"), ((F.col("kind") == "encode") & ~before.eqNullSafe(F.lit("encode"))).alias("begins"))
    copy, encode = F.col("kind") == "copy", F.col("kind") == "encode"
    zero = F.lit(0).cast("long")
    return s.groupBy("src").agg(F.sum(F.when(copy, F.col("frames")).otherwise(zero)).alias("copied"), F.sum(F.when(encode, F.col("frames")).otherwise(zero)).alias("encoded"), F.count_if(copy).alias("copy_spans"), F.count_if(encode).alias("encode_spans"), F.count_if("begins").alias("encode_runs"))


def worthwhile(stats: DataFrame, lengths: DataFrame, groups: DataFrame) -> DataFrame:
    """Whether copying costs less than encoding all: what is encoded, a scan of the source, and a group for each restart.

    ``lengths`` has (src, timeline, source_end) in frames.
    """
    mean = groups.where("group_end > frame").groupBy("src").agg(F.greatest(whole_div(F.sum(F.col("group_end") - F.col("frame")), F.count("*")), F.lit(1).cast("long")).alias("group"))
    joined = stats.join(lengths, "src").join(mean, "src", "left").withColumn("group", F.coalesce("group", F.greatest("source_end", F.lit(1).cast("long"))))
    cost = F.col("encoded") + whole_div(F.greatest("source_end", F.lit(0).cast("long")), 32) + F.col("encode_runs") * F.col("group")
    return joined.select("src", "copied", "encoded", "encode_runs", "group", ((F.col("copied") > 0) & (F.col("timeline") > 0) & (cost < F.col("timeline"))).alias("worthwhile"))


def mean_interval(keyframes: DataFrame) -> DataFrame:
    """Mean distance of keyframes of each source, in whole frames, at least 1."""
    w = Window.partitionBy("src").orderBy("frame")
    gaps = keyframes.select("src", "frame").distinct().select("src", (F.lead("frame").over(w) - F.col("frame")).alias("gap")).where("gap is not null")
    return gaps.groupBy("src").agg(F.greatest(whole_div(F.sum("gap"), F.count("*")), F.lit(1).cast("long")).alias("interval"))
