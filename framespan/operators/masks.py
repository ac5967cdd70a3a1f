"""Boolean masks and label series over frames.

A mask by itself has a row for each frame of its length. Masks over one table of frames are
nullable Boolean columns instead, null beyond a mask's length: then a whole expression is a
projection (``col_or`` and its like), without any shuffle. Masks of different tables are
brought together by one aggregation (``any_of`` and its like, or ``wide``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.functions.columns import u16


def col_or(*operands: Column) -> Column:
    """``or`` of nullable masks: null where all are, else missing ones are false."""
    return F.when(F.coalesce(*operands).isNotNull(), reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in operands)))


def col_and(*operands: Column) -> Column:
    """``and`` of nullable masks: null where any is."""
    present = reduce(lambda a, b: a & b, (x.isNotNull() for x in operands))
    return F.when(present, reduce(lambda a, b: a & b, operands))


def col_xor(*operands: Column) -> Column:
    """``xor`` of nullable masks: null where all are, else missing ones are false."""
    odd = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(False)).cast("int") for x in operands)) % 2 == 1
    return F.when(F.coalesce(*operands).isNotNull(), odd)


def col_label(labelled: list[tuple[int, Column]]) -> Column:
    """The highest label whose nullable mask is true, 0 where none is, null where all are missing."""
    value = F.greatest(F.lit(0), *(F.when(F.coalesce(c, F.lit(False)), F.lit(k)).otherwise(0) for k, c in labelled))
    return F.when(F.coalesce(*(c for _, c in labelled)).isNotNull(), value)


def col_above(level: Column, threshold: float) -> Column:
    return level >= u16(F.lit(threshold))


def as_mask(frames: DataFrame, on: Column, name: str = "on") -> DataFrame:
    """A mask (src, frame, on) from a nullable column of a table of frames."""
    return frames.select("src", "frame", on.alias(name)).where(F.col(name).isNotNull())


def wide(masks: dict[str, DataFrame]) -> DataFrame:
    """Masks (src, frame, on) of different tables as nullable columns of one: one union, one aggregation."""
    rows = (m.select("src", "frame", F.lit(k).alias("k"), "on") for k, m in masks.items())
    return reduce(DataFrame.union, rows).groupBy("src", "frame").agg(*(F.max(F.when(F.col("k") == k, F.col("on"))).alias(k) for k in masks))


def above(levels: DataFrame, threshold: float, column: str = "u16") -> DataFrame:
    """Mask of the frames at or above a threshold from 0 to 1."""
    return levels.select("src", "frame", (F.col(column) >= u16(F.lit(threshold))).alias("on"))


def _tagged(masks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (m.select("src", "frame", "on", F.lit(k).alias("operand")) for k, m in enumerate(masks)))


def any_of(masks: list[DataFrame]) -> DataFrame:
    """``or``: as long as the longest operand, missing frames false. One shuffle for any number of operands."""
    return _tagged(masks).groupBy("src", "frame").agg(F.bool_or("on").alias("on"))


def all_of(masks: list[DataFrame]) -> DataFrame:
    """``and``: as long as the shortest operand."""
    grouped = _tagged(masks).groupBy("src", "frame").agg(F.bool_and("on").alias("on"), F.count("*").alias("n"))
    return grouped.where(F.col("n") == len(masks)).select("src", "frame", "on")


def odd_of(masks: list[DataFrame]) -> DataFrame:
    """``xor``: as long as the longest operand, true where an odd number of operands is."""
    return _tagged(masks).groupBy("src", "frame").agg((F.count_if("on") % 2 == 1).alias("on"))


def none_of(mask: DataFrame) -> DataFrame:
    """``not``: as long as its operand."""
    return mask.select("src", "frame", (~F.col("on")).alias("on"))


def everything(lengths: DataFrame, on: bool = True) -> DataFrame:
    """A mask of one value over the length (src, length) of each source; sources without frames have no rows."""
    return lengths.where("length > 0").select("src", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("frame"), F.lit(on).alias("on"))


def nothing(lengths: DataFrame) -> DataFrame:
    """The empty mask."""
    return everything(lengths).where("false")


def merge_labels(labelled: list[tuple[int, DataFrame]]) -> DataFrame:
    """Label series (src, frame, label): the highest label whose mask is true, 0 where none is."""
    rows = (m.select("src", "frame", F.when(F.col("on"), F.lit(k)).otherwise(0).alias("label")) for k, m in labelled)
    return reduce(DataFrame.union, rows).groupBy("src", "frame").agg(F.max("label").alias("label"))


def fold_back(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Labels after their mask was changed: 0 where it is false, 1 where it became true."""
    joined = labels.join(mask, ["src", "frame"], "full")
    label = F.when(~F.coalesce("on", F.lit(False)), 0).otherwise(F.when(F.coalesce("label", F.lit(0)) == 0, 1).otherwise(F.col("label")))
    return joined.select("src", "frame", label.alias("label"))


def cue_mask(cues: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Mask of the frames of cues (src, start, end, text) that match, as long as the last cue of any kind.

    Cues without text, or that do not last, count for nothing.
    """
    match = F.col("text").rlike(("(?i)" if ignore_case else "") + pattern) & F.col("src").isNotNull()
    real = cues.where("end > start and text is not null").select("src", F.floor("start").cast("int").alias("low"), F.ceil("end").cast("int").alias("high"), match.alias("match"))
    # Runs of frames follow from one pass over the cues in order; only at the end each frame is spelled out.
    order = Window.partitionBy("src").orderBy(F.when(F.col("match"), F.col("low")))
    stop = F.when(F.col("match"), F.col("high"))
    before = F.coalesce(F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    so_far = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = real.select("src", "match", "low", stop.alias("stop"), before.alias("before"), F.when(F.lead("low").over(order).isNull(), so_far).alias("length"))
    run = lambda a, b, on: F.struct(a.alias("a"), b.alias("b"), F.lit(on).alias("on"))
    c = F.col
    runs = F.array(run(c("before"), F.when(c("match"), c("low")), False), run(F.greatest("before", "low"), c("stop"), True), run(F.greatest("before", "stop"), c("length"), False))
    found = rows.select("src", F.inline(F.filter(runs, lambda r: r["b"] > r["a"])))
    return found.select("src", F.explode(F.sequence("a", c("b") - 1)).alias("frame"), "on")


def word_pattern(word: str) -> str:
    """A pattern for a whole word, taken literally."""
    return r"\b" + "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in word) + r"\b"


def cue_overlaps(cues: DataFrame, clips: DataFrame, block: int = 256) -> DataFrame:
    """Cues on the timeline of clips (src, offset, dur, start, speed): cut to each clip that they overlap, and moved.

    Clips and cues meet by blocks of source time, so the join is on equality.
    """
    end = F.col("offset") + F.col("dur")
    a = clips.withColumn("clip_end", end).where("dur > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("clip_end") - 1) / block))))
    b = cues.where("end > start").select("src", F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), "text").withColumn("block", F.explode(F.sequence(F.floor(F.col("cue_start") / block), F.floor((F.col("cue_end") - 1) / block))))
    low, high = F.greatest("offset", "cue_start"), F.least("clip_end", "cue_end")
    met = a.join(b, ["src", "block"]).where(low < high).where(F.floor(low / block) == F.col("block"))
    return met.select("src", (F.col("start") + low - F.col("offset")).alias("start"), (F.col("start") + high - F.col("offset")).alias("end"), "text")
