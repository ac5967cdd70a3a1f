"""Samples and metadata of PCM WAV files, decoded next to the data."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Samples in a row of the output.
BLOCK = 1 << 16


def _decode(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            with wave.open(io.BytesIO(content)) as w:
                channels, width, rate, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
                at = 0
                while at < n:
                    raw = w.readframes(min(BLOCK, n - at))
                    own = to_int16(raw, width).reshape(-1, channels)
                    for c in range(channels):
                        yield pa.RecordBatch.from_pydict(
                            {"src": [path], "rate": pa.array([rate], pa.int32()), "channel": pa.array([c], pa.int32()), "first": [at], "samples": pa.array([own[:, c]], pa.list_(pa.int16()))}
                        )
                    at += len(own)


def to_int16(raw: bytes, width: int) -> np.ndarray:
    """PCM of 1 to 4 bytes as 16 bits: 8-bit is unsigned, wider ones lose their low bits."""
    if width == 1:
        return ((np.frombuffer(raw, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
    if width == 2:
        return np.frombuffer(raw, "<i2")
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (b[:, 1].astype(np.uint16) | (b[:, 2].astype(np.uint16) << 8)).view(np.int16)
    return (np.frombuffer(raw, "<i4") >> 16).astype(np.int16)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (src, rate, channel, first, samples) of all WAV files below a path; a file is decoded by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInArrow(_decode, "src string, rate int, channel int, first long, samples array<smallint>")


def samples(blocks: DataFrame) -> DataFrame:
    """Rows (src, channel, idx, v) of blocks."""
    from pyspark.sql import functions as F

    rows = blocks.select("src", "channel", "first", F.posexplode("samples").alias("k", "v"))
    return rows.select("src", "channel", (F.col("first") + F.col("k")).alias("idx"), F.col("v").cast("int").alias("v"))


def sample_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """All samples [start, end) of each source and channel, zero where there are none."""
    from pyspark.sql import functions as F

    keys = rows.select("src", "channel").distinct()
    spine = keys.select("src", "channel", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))).alias("idx"))
    own = rows.where((F.col("idx") >= start) & (F.col("idx") < end))
    return spine.join(own, ["src", "channel", "idx"], "left").select("src", "channel", "idx", F.coalesce("v", F.lit(0)).alias("v"))
