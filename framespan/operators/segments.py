"""Runs of frames: margins, smoothing, run-length encoding, overrides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by_frame() -> Window:
    return Window.partitionBy("src").orderBy("frame")


def margin(mask: DataFrame, start: int, end: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Move the starts and ends of true runs outwards (positive) or inwards (negative).

    Edges are those of the mask as it was; the end rule has the last word. A run at the
    first frame has no start edge, one at the last frame no end edge. Columns in ``keep`` stay.
    """
    edges = mask.select("src", "frame", "on", *keep, F.lag("on").over(_by_frame()).alias("was"))
    edges = edges.select("src", "frame", "on", *keep, F.coalesce(F.col("on") & ~F.col("was"), F.lit(False)).alias("s"), F.coalesce(~F.col("on") & F.col("was"), F.lit(False)).alias("e"))

    def near(edge: str, low: int, high: int):
        return F.coalesce(F.bool_or(edge).over(_by_frame().rowsBetween(low, high)), F.lit(False))

    out = F.col("on")
    if start > 0:
        out = F.when(near("s", 1, start), True).otherwise(out)
    elif start < 0:
        out = F.when(near("s", start + 1, 0), False).otherwise(out)
    if end > 0:
        out = F.when(near("e", 1 - end, 0), True).otherwise(out)
    elif end < 0:
        out = F.when(near("e", 1, -end), False).otherwise(out)
    return edges.select("src", "frame", out.alias("on"), *keep)


def runs(series: DataFrame, value: str = "on") -> DataFrame:
    """Run-length encoding: (src, start, end, value) of maximal runs of equal values, half-open."""
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(_by_frame())) & F.lag("frame").over(_by_frame()).isNotNull(), 0).otherwise(1)
    numbered = series.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(_by_frame().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("src", "run").agg(F.min("frame").cast("long").alias("start"), (F.max("frame") + 1).cast("long").alias("end"), F.first(value).alias(value)).drop("run")


def smooth_runs(own: list[tuple[bool, int]], min_cut: int, min_clip: int) -> list[tuple[bool, int]]:
    """Flip all runs that are too short, at once, until nothing changes or two states alternate."""

    def merged(parts):
        out: list[list] = []
        for v, n in parts:
            if out and out[-1][0] == v:
                out[-1][1] += n
            else:
                out.append([v, n])
        return [tuple(x) for x in out]

    state, before = merged(own), None
    while True:
        after = merged((v != (n < (min_clip if v else min_cut)), n) for v, n in state)
        if after == state or after == before:
            return after
        state, before = after, state


def smooth(chunks: DataFrame, min_cut: int, min_clip: int) -> DataFrame:
    """``smooth_runs`` on the runs of each source: (src, start, end, on) to the same.

    How many passes it takes depends on the data, so it runs on the runs of a source, not on
    its frames; a source's runs must fit one task, which holds two numbers for each.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        out = smooth_runs([(bool(v), int(n)) for v, n in zip(pdf["on"], pdf["end"] - pdf["start"])], min_cut, min_clip)
        ends = pd.Series([n for _, n in out], dtype="int64").cumsum()
        return pd.DataFrame({"src": pdf["src"].iloc[0], "start": ends - [n for _, n in out], "end": ends, "on": [v for v, _ in out]})

    kind = dict(chunks.dtypes)["src"]
    return chunks.select("src", "start", "end", "on").groupBy("src").applyInPandas(one, f"src {kind}, start long, end long, on boolean")


def frames_of(chunks: DataFrame, value: str = "on") -> DataFrame:
    """Frames again, from runs."""
    return chunks.where("end > start").select("src", F.explode(F.sequence(F.col("start").cast("int"), (F.col("end") - 1).cast("int"))).alias("frame"), value)


def normalized(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ranges (seq, start, stop, action) on each source: negative ends count from its length, clamped at 0."""
    every = ranges.agg(F.collect_list(F.struct("seq", "start", "stop", "action")).alias("r"))  # the flags that a user gave, in one row
    both = lengths.join(F.broadcast(every)).select("src", "length", F.inline("r"))
    at = lambda c: F.greatest(F.when(F.col(c) < 0, F.col("length") + F.col(c)).otherwise(F.col(c)), F.lit(0))
    return both.select("src", "length", "seq", "action", at("start").alias("start"), F.least(at("stop"), F.col("length")).alias("stop")).where("start < stop")


def override(labels: DataFrame, ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Action index of each frame: its label, or what the last range (in order of seq) that holds it says.

    A range may extend the series up to the source's length; frames that are then missing have label 0.
    """
    painted = normalized(ranges, lengths).select("src", "seq", "action", F.explode(F.sequence(F.col("start").cast("int"), (F.col("stop") - 1).cast("int"))).alias("frame"))
    rows = labels.select("src", "frame", "label", F.lit(None).cast("int").alias("action"), F.lit(None).cast("int").alias("seq"))
    rows = rows.union(painted.select("src", "frame", F.lit(None).cast("int"), "action", "seq"))
    last = rows.groupBy("src", "frame").agg(F.max("label").alias("label"), F.max_by("action", "seq").alias("action"))
    # Frames between what the labels and the ranges name have no row yet: each row spells out those before it.
    low = F.coalesce(F.lag("frame").over(_by_frame()) + 1, F.lit(0))
    spelled = last.withColumn("low", low).select("src", "label", "action", F.col("frame").alias("own"), F.explode(F.sequence("low", "frame")).alias("frame"))
    return spelled.select("src", "frame", F.when(F.col("frame") == F.col("own"), F.coalesce("action", "label")).alias("action")).select("src", "frame", F.coalesce("action", F.lit(0)).alias("action"))


def complement(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Gaps (src, start, end) between the spans of a source, before the first and after the last."""
    order = Window.partitionBy("src").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inner = spans.select("src", reach.alias("gap_start"), F.col("start").alias("gap_end"))
    tail = lengths.join(spans.groupBy("src").agg(F.max("end").alias("reach")), "src", "left").select("src", F.coalesce("reach", F.lit(0).cast("long")).alias("gap_start"), F.col("length").cast("long").alias("gap_end"))
    return inner.union(tail).where("gap_end > gap_start").select("src", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def iterate_chunks(values: list) -> Iterator[tuple[int, int, object]]:
    """Runs (start, end, value) of a list."""
    low = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[low]:
            yield low, k, values[low]
            low = k
