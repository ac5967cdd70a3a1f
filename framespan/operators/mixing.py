"""Several layers at once: which clips are active, sums, side chains, peaks, ramps over frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framespan.functions.columns import clip_position, ease, sample_keyframes, whole_div


def active(clips: DataFrame) -> DataFrame:
    """A row for each frame and clip that covers it, by layer."""
    return clips.where("dur > 0").select("*", F.explode(F.sequence("start", F.col("start") + F.col("dur") - 1)).alias("frame"))


def source_frame(frame: Column, start: Column, offset: Column, speed: Column, rate: Column | float = 1.0) -> Column:
    """The frame of the source that shows at a frame of the timeline; ``rate`` is source frames per timeline frame."""
    at = F.round((frame - start + offset) * rate)
    return F.round(at * speed).cast("long")


def mix(clips: DataFrame, level: str = "level") -> DataFrame:
    """Sum of the levels of all clips at each frame, as changes at clip edges: (src, start, end, level).

    Only the edges are sorted, no frame is spelled out.
    """
    edges = clips.where("dur > 0").select("src", F.explode(F.array(F.struct(F.col("start").alias("at"), F.col(level).alias("d")), F.struct((F.col("start") + F.col("dur")).alias("at"), (-F.col(level)).alias("d")))).alias("e"))
    steps = edges.groupBy("src", F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("src").orderBy("start")
    run = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("src", "start", F.lead("start").over(w).alias("end"), run.alias("level")).where("end is not null")


def side_chain(clips: DataFrame, block: int = 256) -> DataFrame:
    """Pairs of a clip and a clip of a higher layer that sounds at the same time, with their common frames.

    Clips meet by blocks of time and are counted in the first block that both touch.
    """
    end = F.col("start") + F.col("dur")
    c = clips.where("dur > 0").select("src", "layer", "ord", "start", end.alias("end")).withColumn("block", F.explode(F.sequence(whole_div(F.col("start"), block), whole_div(F.col("end") - 1, block))))
    a = c.select("src", "block", *(F.col(x).alias(f"a_{x}") for x in ("layer", "ord", "start", "end")))
    b = c.select("src", "block", *(F.col(x).alias(f"b_{x}") for x in ("layer", "ord", "start", "end")))
    low, high = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    met = a.join(b, ["src", "block"]).where((F.col("b_layer") > F.col("a_layer")) & (low < high) & (whole_div(low, block) == F.col("block")))
    return met.select("src", F.col("a_layer").alias("layer"), F.col("a_ord").alias("ord"), F.col("b_layer").alias("key_layer"), F.col("b_ord").alias("key_ord"), low.alias("start"), high.alias("end"))


def normalize_peak(samples: DataFrame, target: float, value: str = "v") -> DataFrame:
    """Samples scaled so that the largest of all is ``target``; silence stays as it is. One global maximum, then a map."""
    peak = samples.agg(F.max(F.abs(F.col(value))).alias("peak"))  # one row
    scale = F.when(F.col("peak") > 0, F.lit(target) / F.col("peak")).otherwise(1.0)
    return samples.join(F.broadcast(peak)).withColumn(value, F.col(value) * scale).drop("peak")


def ramp(clips: DataFrame, values: list[float], curve: str = "linear", length: int | None = None) -> DataFrame:
    """The value of an eased ramp through ``values`` at each frame of each clip: (src, ord, frame, value).

    It takes the whole clip, or ``length`` frames and then holds.
    """
    steps = active(clips).withColumn("local", F.col("frame") - F.col("start"))
    over = F.lit(length) if length is not None else F.col("dur")
    value = sample_keyframes(F.array(*(F.lit(float(v)) for v in values)), ease(curve, clip_position(F.col("local"), over)))
    return steps.select("src", "ord", "frame", value.alias("value"))


def keyframed_volume(samples: DataFrame, clips: DataFrame, values: list[float], curve: str = "linear", length: int | None = None) -> DataFrame:
    """16-bit samples (src, ord, local, v) of clips, each times the value of an eased ramp at its place, rounded half away from zero and clamped.

    The ramp takes all samples of a clip (src, ord, dur), or ``length`` of them and then holds.
    """
    over = F.lit(length) if length is not None else F.col("dur")
    share = sample_keyframes(F.array(*(F.lit(float(v)) for v in values)), ease(curve, clip_position(F.col("local"), over)))
    joined = samples.join(clips.select("src", "ord", "dur"), ["src", "ord"])
    return joined.select("src", "ord", "local", F.least(F.greatest(F.round(F.col("v") * share), F.lit(-32768)), F.lit(32767)).cast("int").alias("v"))


def edge_gain(local: Column, dur: Column, fade: int, joined_left: Column, joined_right: Column) -> Column:
    """Gain of a short fade at the ends of a clip, but not where it continues its neighbour."""
    left = F.when(joined_left, F.lit(1.0)).otherwise(F.least((local + 1) / F.lit(fade), F.lit(1.0)))
    right = F.when(joined_right, F.lit(1.0)).otherwise(F.least((dur - local) / F.lit(fade), F.lit(1.0)))
    return F.least(left, right)


def same_run(clips: DataFrame) -> DataFrame:
    """Clips with whether each goes on from the one before it, and into the one after, in source and timeline."""
    w = Window.partitionBy("src").orderBy("start", "ord")
    goes_on = (F.lag(F.col("start") + F.col("dur")).over(w) == F.col("start")) & (F.lag(F.col("offset") + F.col("dur")).over(w) == F.col("offset"))
    marked = clips.withColumn("joined_left", F.coalesce(goes_on, F.lit(False)))
    return marked.withColumn("joined_right", F.coalesce(F.lead("joined_left").over(w), F.lit(False)))


def envelope(keys: Column, threshold: float, floor: float, attack: float, release: float) -> Column:
    """Gain for each key level of an array: towards ``floor`` above the threshold and back to 1, by one-pole steps.

    Each value depends on the one before it, so it is a fold over the array of a clip.
    """
    target = lambda k: F.when(k > threshold, F.lit(floor)).otherwise(F.lit(1.0))

    def step(acc, k):
        t, cur = target(k), acc["cur"]
        nxt = t + (cur - t) * F.when(t < cur, F.lit(attack)).otherwise(F.lit(release))
        return F.struct(nxt.alias("cur"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    zero = F.struct(F.lit(1.0).alias("cur"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(keys, zero, step, lambda acc: acc["out"])


def micro_fade(samples: DataFrame, clips: DataFrame, fade: int) -> DataFrame:
    """Samples (src, ord, local, v) with a short fade at either end of clips that do not continue a neighbour."""
    marked = same_run(clips).select("src", "ord", "dur", "joined_left", "joined_right")
    joined = samples.join(marked, ["src", "ord"])
    gain = edge_gain(F.col("local"), F.col("dur"), fade, F.col("joined_left"), F.col("joined_right"))
    return joined.select("src", "ord", "local", (F.col("v") * gain).alias("v"))


def gains(rows: DataFrame, keys: tuple[str, ...], threshold: float, floor: float, attack: float, release: float) -> DataFrame:
    """The ``envelope`` of key levels (*keys, idx, k, ...) as a column ``gain`` instead of ``k``.

    A value depends on the one before it, so a source is gone through in order; what is carried
    from batch to batch is one number, so a source of any length needs the memory of a batch.
    """
    kept = [c for c in rows.columns if c != "k"]
    ordered = rows.select(*kept, F.col("k").cast("double").alias("k")).repartition(*keys).sortWithinPartitions(*keys, "idx")
    schema = T.StructType([*(ordered.schema[c] for c in kept), T.StructField("gain", T.DoubleType())])

    def run(batches):
        own, gain = None, 1.0
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in keys]
            out = []
            for key, k in zip(zip(*names), batch.column("k").to_pylist()):
                if key != own:
                    own, gain = key, 1.0
                target = floor if k is not None and k > threshold else 1.0
                gain = target + (gain - target) * (attack if target < gain else release)
                out.append(gain)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], names=[*kept, "gain"])

    return ordered.mapInArrow(run, schema)


def duck(samples: DataFrame, keys: DataFrame, threshold: float, amount: float, attack: float, release: float) -> DataFrame:
    """Samples (src, idx, v) made quieter while the key (src, idx, v) of higher layers is loud."""
    key = keys.groupBy("src", "idx").agg(F.sum("v").alias("k"))
    both = samples.select("src", "idx", "v").join(key, ["src", "idx"], "left").withColumn("k", F.abs(F.coalesce("k", F.lit(0.0))))
    return gains(both, ("src",), threshold, max(0.0, 1 - amount), attack, release).select("src", "idx", (F.col("v") * F.col("gain")).alias("v"))


def mix_samples(samples: DataFrame) -> DataFrame:
    """Sum of 16-bit samples (src, idx, channel, v) of all layers, clamped."""
    total = F.sum(F.col("v").cast("long"))
    return samples.groupBy("src", "idx", "channel").agg(F.greatest(F.least(total, F.lit(32767)), F.lit(-32768)).cast("int").alias("v"))
