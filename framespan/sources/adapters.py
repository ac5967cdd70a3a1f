"""Tables read as signals: levels, samples, cues, frames, clips and keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import u16, whole_div

HOUR_US = 3_600_000_000
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01
FULL_SCALE, FULL_COUNT = 500.0, 20.0


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    since = (F.col(ts) if isinstance(ts, str) else ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def event_frames(events: DataFrame, bucket_us: int = HOUR_US, origin_us: int = EPOCH_US) -> DataFrame:
    """Per source and bucket of time: frame, the highest value and the number of events. Aggregated before any shuffle."""
    frame = whole_div(micros("ts") - F.lit(origin_us), bucket_us).cast("int")
    return events.select(F.col("event_type").alias("src"), frame.alias("frame"), "value").groupBy("src", "frame").agg(F.max("value").alias("top"), F.count("*").alias("n"))


def dense(frames: DataFrame) -> DataFrame:
    """One row for every frame from 0 to the last of each source, absent ones with nulls.

    Each frame spells out those since the one before it, so the series is read once.
    """
    low = F.coalesce(F.lag("frame").over(Window.partitionBy("src").orderBy("frame")) + 1, F.lit(0))
    values = [c for c in frames.columns if c not in ("src", "frame")]
    spelled = frames.withColumn("low", low).select("src", "frame", *values, F.explode(F.sequence("low", "frame")).alias("at"))
    return spelled.select("src", F.col("at").alias("frame"), *(F.when(F.col("at") == F.col("frame"), F.col(c)).alias(c) for c in values))


def event_levels(events: DataFrame, **kw) -> DataFrame:
    """Level series (src, frame, u16, u16_count): by the highest value and by the number of events."""
    level = F.least(F.coalesce("top", F.lit(0.0)) / FULL_SCALE, F.lit(1.0))
    count = F.least(F.coalesce("n", F.lit(0)).cast("double") / FULL_COUNT, F.lit(1.0))
    return dense(event_frames(events, **kw)).select("src", "frame", u16(level).alias("u16"), u16(count).alias("u16_count"))


def event_samples(events: DataFrame, block_us: int = HOUR_US) -> DataFrame:
    """Samples (src, idx, v) in order of time within an event type.

    Rows are counted by block of time; within a block they are numbered on from the counts of
    those before it. So types, of which there are few, are not sorted as a whole.
    """
    rows = events.select(F.col("event_type").alias("src"), whole_div(micros("ts"), block_us).alias("block"), "ts", "event_id", F.col("value").alias("v"))
    counts = rows.groupBy("src", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("src", "block", F.coalesce(before, F.lit(0).cast("long")).alias("first"))
    within = F.row_number().over(Window.partitionBy("src", "block").orderBy("ts", "event_id"))
    return rows.withColumn("n", within).join(first, ["src", "block"]).select("src", (F.col("first") + F.col("n") - 1).alias("idx"), "v")


def conversation_cues(conversations: DataFrame) -> DataFrame:
    """Cues (src, turn, start, end, text): a turn lasts as many frames as it has characters, at least one."""
    dur = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "text", dur.alias("dur"))
    start = F.coalesce(F.sum("dur").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(F.col("conv_id").cast("long").alias("src"), F.col("turn").cast("long").alias("turn"), start.alias("start"), (start + F.col("dur")).alias("end"), "text")


def embedding_frames(embeddings: DataFrame) -> DataFrame:
    """Frames (idx, px): each vector as an image line of 0 to 255."""
    px = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 127.5).cast("int"))
    return embeddings.select(F.col("vec_id").cast("long").alias("idx"), px.alias("px"))


def order_clips(lineitem: DataFrame) -> DataFrame:
    """Clips (src, ord, start, dur, offset): the lines of an order end to end, numbered from 1, as long as their quantity.

    ``offset`` leaves a gap of a frame after each line whose number is even.
    """
    line = Window.partitionBy("src").orderBy("l_linenumber", "l_partkey", "l_suppkey", "dur", "l_extendedprice")
    rows = lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_quantity").cast("long").alias("dur"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.select("src", F.row_number().over(line).cast("long").alias("ord"), "dur")
    order = Window.partitionBy("src").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("dur").over(order), F.lit(0))
    gaps = F.coalesce(F.sum(1 - F.col("ord") % 2).over(order), F.lit(0))
    return rows.select("src", "ord", start.alias("start"), "dur", (start + gaps).alias("offset"))


def order_keyframes(lineitem: DataFrame, every: int = 12) -> DataFrame:
    """Keyframes (src, frame) of an order: every twelfth frame up to its last line."""
    last = lineitem.groupBy(F.col("l_orderkey").alias("src")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return last.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"), F.lit(every).cast("long"))).alias("frame"))
