"""Clips on a timeline: from runs to clips, appending, effect groups, overlays, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import clip_bounds, whole_div

#: A speed of a section that is cut.
CUT_SPEED = 99999.0


def before(column: Column | str, *partition: str, order: tuple[str, ...]) -> Column:
    """Sum of a column over the rows before this one, 0 for the first."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0).cast("long"))


def speed_product(speeds: Column) -> Column:
    """Product of the speeds of an action group, each stored as a 32-bit number."""
    return F.aggregate(speeds, F.lit(1.0), lambda a, x: a * x.cast("float").cast("double"))


def clips(chunks: DataFrame, actions: DataFrame, value: str = "label") -> DataFrame:
    """Clips (src, ord, start, dur, offset, value) of chunks (src, start, end, value).

    ``actions`` has the speed of each value (``CUT_SPEED`` or null: cut). Cut chunks and those
    that round to nothing are left out; starts are sums of the durations before. The table of
    actions holds what a user wrote and is broadcast.
    """
    joined = chunks.join(F.broadcast(actions), value).where(F.col("speed").isNotNull() & (F.col("speed") > 0) & (F.col("speed") < CUT_SPEED))
    offset, dur = clip_bounds(F.col("start"), F.col("end"), F.col("speed"))
    kept = joined.select("src", F.col("start").alias("at"), value, "speed", offset.alias("offset"), dur.alias("dur")).where("dur > 0")
    order = Window.partitionBy("src").orderBy("at")
    return kept.select("src", (F.row_number().over(order) - 1).cast("long").alias("ord"), before("dur", "src", order=("at",)).alias("start"), "dur", "offset", value, "speed")


def append(timelines: DataFrame, order: str = "input") -> DataFrame:
    """Clips of several inputs (input, ord, start, dur, ...) end to end: each begins where those before it end.

    Of each input one row is sorted; a user names the inputs, so they are few.
    """
    lengths = timelines.groupBy(order).agg(F.max(F.col("start") + F.col("dur")).alias("length"))
    begins = lengths.select(order, (F.sum("length").over(Window.orderBy(order)) - F.col("length")).alias("begin"))  # a row for each input
    return timelines.join(begins, order).withColumn("start", F.col("start") + F.col("begin")).drop("begin")


def dense_effects(rows: DataFrame, group: str, ord_: str, partition: str | None = None, block: int = 1 << 16) -> DataFrame:
    """Number the distinct effect groups from 0 by where each first occurs (within ``partition``).

    ``ord_`` is a whole number. Groups are numbered within blocks of it, on from the counts of the
    blocks before; a sort over all has one row for each block that a group begins in.
    """
    keys = [partition] if partition else []
    first = rows.groupBy(*keys, group).agg(F.min(ord_).alias("first")).withColumn("block", whole_div(F.col("first"), block))
    counts = first.groupBy(*keys, "block").agg(F.count("*").alias("n"))
    counts = counts.select(*keys, "block", before("n", *keys, order=("block",)).alias("base"))
    number = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("first", group)) - 1
    ids = first.withColumn("number", number).join(counts, [*keys, "block"]).select(*keys, group, (F.col("base") + F.col("number")).cast("long").alias("effects"))
    return rows.join(ids, [*keys, group])


def overlays(base: DataFrame, adds: DataFrame) -> DataFrame:
    """A layer for each overlay (seq, selector, path, follow_base) over the base clips whose value it selects.

    With ``follow_base`` the overlay keeps the base clip's offset, else it begins at 0 in each.
    """
    hit = base.join(F.broadcast(adds), base["label"] == adds["selector"])
    used = hit.select("seq").distinct()
    layers = used.select("seq", F.row_number().over(Window.orderBy("seq")).cast("int").alias("layer"))
    return hit.join(F.broadcast(layers), "seq").select("layer", F.col("path").alias("media"), "src", "start", "dur", F.when(F.col("follow_base"), F.col("offset")).otherwise(F.lit(0)).alias("offset"))


def timeline_length(rows: DataFrame) -> DataFrame:
    """End of the last clip, over all layers of each timeline (src, layer, ord, start, dur)."""
    last = rows.groupBy("src", "layer").agg(F.max_by(F.col("start") + F.col("dur"), "ord").alias("end"))
    return last.groupBy("src").agg(F.max("end").alias("length"))


def statistics(clips_: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Number, shortest, longest, mean and median duration of clips, with the length of output against input."""
    own = clips_.agg(
        F.count("*").alias("n"), F.min("dur").alias("shortest"), F.max("dur").alias("longest"), F.avg("dur").alias("mean"), F.expr("percentile(dur, 0.5)").alias("median"), F.sum("dur").alias("output")
    )
    if lengths is None:
        return own
    total = lengths.agg(F.sum("length").alias("input"))
    percent = F.when(F.col("input") > 0, F.round(F.col("output") / F.col("input") * 100, 2))
    return own.join(total).withColumn("percent", percent)  # one row each


def cut_lengths(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Lengths of what the spans leave out of each source."""
    from framespan.operators.segments import complement

    return complement(spans, lengths).select("src", "start", (F.col("end") - F.col("start")).alias("cut"))


def is_linear(timelines: DataFrame) -> DataFrame:
    """Whether each timeline (tl, clips2 or null) can be written as v1 or v2: it has plain clips, or nothing."""
    return timelines.select("tl", (F.coalesce(F.size("clips2"), F.lit(0)) > 0).alias("linear"))


def distinct_sources(rows: DataFrame) -> DataFrame:
    """Number of sources of each timeline (src, media), over all its tracks."""
    return rows.groupBy("src").agg(F.countDistinct("media").alias("sources"))


def selected_any(base: DataFrame, selectors: list[int], value: str = "label") -> DataFrame:
    """Whether any clip of a timeline has one of the values."""
    return base.groupBy("src").agg(F.bool_or(F.col(value).isin(selectors)).alias("any"))


def gap_rows(rows: DataFrame) -> DataFrame:
    """Gaps (src, layer, start, dur) before clips that do not begin where the one before ends."""
    w = Window.partitionBy("src", "layer").orderBy("start", "ord")
    reach = F.coalesce(F.lag(F.col("start") + F.col("dur")).over(w), F.lit(0).cast("long"))
    return rows.select("src", "layer", reach.alias("start"), (F.col("start") - reach).alias("dur")).where("dur > 0")


def playlist_parity(planned: DataFrame) -> DataFrame:
    """Which of a track's two playlists each clip goes to: it changes with every centred dissolve that comes in."""
    w = Window.partitionBy("track").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return planned.withColumn("parity", (F.count_if(F.coalesce(F.col("incoming.alignment") == "center", F.lit(False))).over(w) % 2).cast("int"))


def merge_order(rows: DataFrame, key: str = "src", at: str = "start", layer: str = "layer") -> DataFrame:
    """Clips or packets of several layers in one order: the one that begins first comes next, of equals that of the lowest layer."""
    w = Window.partitionBy(key).orderBy(at, layer, "ord")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def audio_tracks(layers: DataFrame) -> DataFrame:
    """Tracks of an editor for layers of sound (src, layer, channels): a layer of two or more channels is split into two tracks.

    Rows (src, layer, exploded, track): ``track`` counts the channels of the layers before, from 1.
    """
    counted = layers.withColumn("channels", F.greatest(F.coalesce("channels", F.lit(1)), F.lit(1)).cast("long"))
    counted = counted.withColumn("offset", before("channels", "src", order=("layer",)))
    parts = F.explode(F.sequence(F.lit(0), F.least(F.col("channels"), F.lit(2)).cast("int") - 1)).alias("exploded")
    return counted.select("src", "layer", "offset", parts).select("src", "layer", "exploded", (F.col("offset") + F.col("exploded") + 1).alias("track"))


def link_ids(rows: DataFrame, order: str = "at") -> DataFrame:
    """One number for clips of the same source and start, counted by where each first occurs in a timeline."""
    first = rows.groupBy("src", "media", "start").agg(F.min(order).alias("first"))
    w = Window.partitionBy("src").orderBy("first", "media", "start")
    return rows.join(first.select("src", "media", "start", F.row_number().over(w).cast("long").alias("link")), ["src", "media", "start"])


def first_definition(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows with the value that was defined first for their key."""
    defined = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias("resolved"))
    return rows.join(defined, key, "left")


def with_sidecar(media: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Media that have a subtitle file of the same stem beside them."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    sides = files.where(F.lower(F.col(path)).rlike(r"\.(srt|ass|vtt)$")).select(stem(F.col(path)).alias("stem"))
    return media.withColumn("stem", stem(F.col(path))).join(sides, "stem", "left_semi").drop("stem")


def retarget(rows: DataFrame, **settings) -> DataFrame:
    """Settings of a timeline (samplerate, resolution, background, ...) replaced where a value is given."""
    return rows.withColumns({k: F.lit(v) for k, v in settings.items() if v is not None})


def per_clip(rows: DataFrame) -> DataFrame:
    """Each clip as a timeline of its own that begins at 0: a new column ``part`` numbers them."""
    w = Window.partitionBy("src").orderBy("start")
    return rows.select("*", F.row_number().over(w).cast("long").alias("part")).withColumn("start", F.lit(0).cast("long"))


def one_stream_sources(rows: DataFrame) -> DataFrame:
    """Clips on a source of a single stream each: the stream is part of the source's name, and 0 from then on."""
    return rows.withColumn("media", F.concat_ws("#", "media", "stream")).withColumn("stream", F.lit(0))
