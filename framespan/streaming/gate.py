"""A gate that opens on activity: sessions with a longest gap, a least size and a longest duration.

``gate_batch`` is the plain gap rule on a table. ``gate_stream`` holds the same rule in state,
key by key, with windows that are loud or not, a preroll and a flush at a longest duration.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Windows of silence that close a gate, least loud windows to keep it, windows before it that it takes along.
SILENCE, LEAST, PREROLL, LONGEST = 17, 7, 7, 1000


def gate_batch(rows: DataFrame, key: str, gap: int, least: int = 1) -> DataFrame:
    """Sessions (key, start, end, events) of rows (key, t): a gap longer than ``gap`` ends one, smaller ones go."""
    order = Window.partitionBy(key).orderBy("t", *(c for c in rows.columns if c not in (key, "t")))
    fresh = F.when(F.col("t") - F.lag("t").over(order) <= gap, 0).otherwise(1)
    numbered = rows.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "n").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("events"))
    return out.where(F.col("events") >= least).drop("n")


def gate(windows: Iterator[tuple[int, bool]], state: tuple, silence: int = SILENCE, least: int = LEAST, preroll: int = PREROLL, longest: int = LONGEST):
    """Run the gate over (index, loud) windows from a state; yields (start, end, loud windows), and returns the new state.

    A state is (start or -1, last loud, loud count, last index).
    """
    start, last, count, index = state
    out = []
    for index, loud in windows:
        if loud:
            if start < 0:
                start, count = max(index - preroll, 0), 0
            last, count = index, count + 1
        if start >= 0 and (index - last >= silence or index + 1 - start >= longest):
            end = min(last + silence, index) + (0 if index - last >= silence else 1)
            if count >= least:
                out.append((start, end, count))
            start = -1
    return out, (start, last, count, index)


def gate_table(windows: DataFrame, key: str = "src", **rule) -> DataFrame:
    """The gate over a table of (key, idx, loud) rows, replayed in order; what is carried from batch to batch is one state.

    A sound that still goes on at the end is not closed, as in a stream.
    """
    kind = dict(windows.dtypes)[key]

    def run(batches):
        own, state = None, (-1, -1, 0, -1)
        for pdf in batches:
            rows = []
            for value, part in pdf.groupby(key, sort=False):
                if value != own:
                    own, state = value, (-1, -1, 0, -1)
                found, state = gate(zip(part["idx"].tolist(), part["loud"].tolist()), state, **rule)
                rows += [(value, *r) for r in found]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "count"])

    ordered = windows.select(key, "idx", "loud").repartition(key).sortWithinPartitions(key, "idx")
    return ordered.mapInPandas(run, f"{key} {kind}, start long, end long, count long")


def gate_stream(windows: DataFrame, key: str = "src", **rule) -> DataFrame:
    """The gate over a stream of (key, idx, loud) rows that come in order of idx within a key."""
    kind = dict(windows.dtypes)[key]

    def step(group, pdfs, state):
        own = state.get if state.exists else (-1, -1, 0, -1)
        rows = []
        for pdf in pdfs:
            pdf = pdf.sort_values("idx")
            found, own = gate(zip(pdf["idx"].tolist(), pdf["loud"].tolist()), own, **rule)
            rows += found
        state.update(tuple(int(x) for x in own))
        if rows:
            yield pd.DataFrame({key: [group[0]] * len(rows), "start": [r[0] for r in rows], "end": [r[1] for r in rows], "count": [r[2] for r in rows]})

    return windows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, start long, end long, count long", "start long, last long, count long, idx long", "append", "NoTimeout"
    )


def tumbling(samples: DataFrame, timestamp: str, value: str, width: str, watermark: str) -> DataFrame:
    """Loudest value of each window of time of a stream, once it can't change any more."""
    return samples.withWatermark(timestamp, watermark).groupBy("src", F.window(timestamp, width).alias("w")).agg(F.max(F.abs(value)).alias("top")).select("src", F.col("w.start").alias("start"), "top")


def frame_differences(frames: DataFrame, key: str = "src") -> DataFrame:
    """Share of pixels that changed since the frame before, over a stream of (key, idx, px) in order of idx within a key.

    The last frame of each key is the state; the first of all has 0.
    """
    kind = dict(frames.dtypes)[key]

    def step(group, pdfs, state):
        last = state.get[0] if state.exists else None
        for pdf in pdfs:
            rows = []
            for idx, px in sorted(zip(pdf["idx"], pdf["px"]), key=lambda x: x[0]):
                px = [int(v) for v in px]
                moved = 0.0 if last is None else sum(a != b for a, b in zip(last, px)) / max(len(px), 1)
                rows.append((group[0], int(idx), moved))
                last = px
            yield pd.DataFrame(rows, columns=[key, "idx", "moved"])
        state.update((last,))

    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, idx long, moved double", "px array<int>", "append", "NoTimeout")


def in_order(batches: DataFrame, write, checkpoint: str):
    """Start a stream whose batches go to ``write(batch, number)`` one after another, none dropped.

    How much a batch holds is set where the stream is read (``maxFilesPerTrigger``); a slow writer holds the stream back.
    """
    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
