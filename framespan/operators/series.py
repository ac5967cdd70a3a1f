"""Level series: bucket aggregates of samples, frame differences, gap filling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import sample_bucket, u16, whole_div



def loudness(samples: DataFrame, rate: int, timebase: Fraction, value: str = "v", full: float = 32767.0) -> DataFrame:
    """Loudest sample of each bucket as a u16 level: (src, frame, u16). The tail bucket counts as it is."""
    frame = sample_bucket(F.col("idx"), rate, timebase)
    peaks = samples.groupBy("src", frame.alias("frame")).agg(F.max(F.abs(F.col(value))).alias("top"))
    return peaks.select("src", "frame", u16(F.col("top") / full).alias("u16"))


def waveform(samples: DataFrame, bucket: int, value: str = "v", window: tuple[int, int] | None = None, channel: str | None = None) -> DataFrame:
    """Lowest and highest sample of each bucket of ``bucket`` samples, zero included: (src, bucket_start, lo, hi).

    With ``window`` (from, to) only the samples of buckets that overlap it are read; with
    ``channel``, the name of a column, every channel has its own peaks, in the same pass.
    """
    start = whole_div(F.col("idx"), bucket) * bucket
    keys = ["src", *([channel] if channel else [])]
    rows = samples.select(*keys, start.alias("bucket_start"), F.col(value).alias("v"))
    if window:
        rows = rows.where((F.col("bucket_start") + bucket > window[0]) & (F.col("bucket_start") < window[1]))
    return rows.groupBy(*keys, "bucket_start").agg(F.least(F.min("v"), F.lit(0).cast("double")).alias("lo"), F.greatest(F.max("v"), F.lit(0).cast("double")).alias("hi"))


def motion(frames: DataFrame, keys: tuple[str, ...] = (), block: int = 1024) -> DataFrame:
    """Share of pixels that differ from those of the frame before, as a u16 level; the first (of each of ``keys``) is 0.

    Frames (*keys, idx, px) are compared within blocks of ``idx``; the last frame of a block is
    handed on to the next block that has any. So only a row for each block is sorted as a whole.
    """
    own = frames.withColumn("_block", whole_div(F.col("idx"), block))
    ends = own.groupBy(*keys, "_block").agg(F.max_by("px", "idx").alias("_last"))
    handed = ends.select(*keys, F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block")).alias("_block"), "_last").where("_block is not null")
    before = F.coalesce(F.lag("px").over(Window.partitionBy(*keys, "_block").orderBy("idx")), "_last")
    compared = own.join(handed, [*keys, "_block"], "left").withColumn("_before", before)
    moved = F.size(F.filter(F.zip_with("_before", "px", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    return compared.select(*(c for c in frames.columns if c != "px"), u16(F.when(F.col("_before").isNull(), F.lit(0.0)).otherwise(moved / F.size("px"))).alias("u16"))


def blackness(frames: DataFrame, pixel_black: float = 0.1) -> DataFrame:
    """Share of pixels at most as bright as ``pixel_black``, as a u16 level."""
    limit = int(min(max(pixel_black, 0.0), 1.0) * 255 + 0.5)
    dark = F.size(F.filter("px", lambda p: p <= limit))
    return frames.select(*(c for c in frames.columns if c != "px"), u16(dark / F.size("px")).alias("u16"))


def crop(width: int, height: int, x: float, y: float, w: float, h: float) -> tuple[int, int, int, int]:
    """Pixels (left, top, width, height) of a region in fractions, at least one and inside the frame."""
    left, top = min(max(round(x * width), 0), width - 1), min(max(round(y * height), 0), height - 1)
    return left, top, max(1, min(round(w * width), width - left)), max(1, min(round(h * height), height - top))


def fill_backwards(values: DataFrame) -> DataFrame:
    """Dense frames from sparse ones: the value at a frame also holds for those after the one before it."""
    low = F.coalesce(F.lag("frame").over(Window.partitionBy("src").orderBy("frame")) + 1, F.lit(0))
    rows = values.withColumn("low", low)
    return rows.select("src", F.explode(F.sequence("low", "frame")).alias("frame"), *(c for c in values.columns if c not in ("src", "frame")))


def keyframe_at(points: DataFrame, keyframes: DataFrame, key: str = "src") -> DataFrame:
    """The last keyframe at or before each point (key, frame): null where there is none.

    One union, sorted once; the last keyframe is carried forward.
    """
    both = points.select("*", F.lit(None).cast("long").alias("k"), F.lit(1).alias("kind")).unionByName(
        keyframes.select(key, "frame", F.col("frame").cast("long").alias("k"), F.lit(0).alias("kind")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("keyframe", F.last("k", ignorenulls=True).over(order)).where("kind = 1").drop("k", "kind")


def media_length(packets: DataFrame) -> DataFrame:
    """Length of each source: the largest end of its packets (src, pts, dur)."""
    return packets.groupBy("src").agg(F.max(F.col("pts") + F.greatest("dur", F.lit(0).cast("long"))).alias("length"))


def channel_levels(levels: DataFrame, streams: list[int] | None = None, channel: Column | None = None) -> DataFrame:
    """Levels of the chosen streams and channels, the highest at each frame."""
    rows = levels if streams is None else levels.where(F.col("stream").isin(streams))
    rows = rows if channel is None else rows.where(channel)
    return rows.groupBy("src", "frame").agg(F.max("u16").alias("u16"))


#: Channels of common layouts, in their order.
LAYOUTS = {
    "mono": ("center",),
    "stereo": ("left", "right"),
    "2.1": ("left", "right", "lfe"),
    "quad": ("left", "right", "back-left", "back-right"),
    "5.1": ("left", "right", "center", "lfe", "back-left", "back-right"),
    "7.1": ("left", "right", "center", "lfe", "back-left", "back-right", "side-left", "side-right"),
}


def channel_index(layout: str, name: str) -> int | None:
    """The number of a channel in a layout, -1 for all, None if it has no such channel; left, right and center of mono are its only one."""
    if name == "all":
        return -1
    if layout == "mono" and name in ("left", "right", "center"):
        return 0
    own = LAYOUTS.get(layout, ())
    return own.index(name) if name in own else None


def selected_levels(levels: DataFrame, layouts: dict[int, str], stream: str = "all", channel: str = "all") -> DataFrame:
    """Levels (src, frame, u16) of the chosen streams that have the channel: the highest of them at each frame.

    ``levels`` has (src, stream, channel, frame, u16); ``layouts`` the layout of each stream.
    """
    wanted = [k for k in layouts if stream == "all" or k == int(stream)]
    found = [(k, c) for k in wanted if (c := channel_index(layouts[k], channel)) is not None]
    if not found:
        raise ValueError(f"no stream {stream} with channel {channel}")
    match = F.lit(False)
    for k, c in found:
        match = match | ((F.col("stream") == k) & (F.lit(True) if c < 0 else F.col("channel") == c))
    return levels.where(match).groupBy("src", "frame").agg(F.max("u16").alias("u16"))
