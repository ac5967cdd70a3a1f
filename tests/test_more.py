import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators import kernels, mixing, series, timeline
from framespan.plans import edit_language as L
from framespan.streaming.gate import frame_differences


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_channels():
    assert series.channel_index("mono", "left") == 0 and series.channel_index("5.1", "lfe") == 3 and series.channel_index("stereo", "center") is None and series.channel_index("stereo", "all") == -1


def test_single_method():
    assert L.parse_single_method("audio") == ("audio", {"stream": "0", "channel": "all"}) and L.parse_single_method("audio:stream=2")[1]["stream"] == "2"
    assert L.parse_single_method("word:hi")[1]["value"] == "hi"
    for bad in ("or audio motion", "audio:4%", "motion:threshold=1", "none", "(not audio)"):
        with pytest.raises(L.EditError):
            L.parse_single_method(bad)


def test_more_functions(spark):
    raw = bytes(range(250, 256)) + b"ab"
    assert bytes(one(spark, C.base64url(F.lit(base64.urlsafe_b64encode(raw).decode().rstrip("="))))) == raw
    assert one(spark, C.aspect_ratio(F.lit(1920), F.lit(1080))) == "16:9" and one(spark, C.aspect_ratio(F.lit(720), F.lit(576), 16, 15)) == "4:3" and one(spark, C.aspect_ratio(F.lit(1000), F.lit(70))) is None
    packed = C.pack_rect(*(F.lit(v) for v in (0.0, 0.25, 0.5, 1.0)))
    assert np.allclose(one(spark, C.unpack_rect(packed)), [0, 0.25, 0.5, 1], atol=1e-7)
    rows = spark.createDataFrame([(None, None), (2.0, "sec"), (12.4, "frames")], "v double, u string").select(C.ease_length(F.col("v"), F.col("u"), F.lit(99), 30.0)).collect()
    assert [r[0] for r in rows] == [99, 60, 12]


def test_timeline_helpers(spark):
    rows = spark.createDataFrame([("t", 0, "a", 1, 0, 10, 5), ("t", 1, "a", 0, 10, 10, 40)], "src string, ord long, media string, stream int, start long, dur long, offset long")
    assert [r["media"] for r in timeline.one_stream_sources(rows).orderBy("ord").collect()] == ["a#1", "a#0"]
    assert [(r["part"], r["start"]) for r in timeline.per_clip(rows).orderBy("part").collect()] == [(1, 0), (2, 0)]
    assert timeline.retarget(rows, samplerate=44100, background=None).columns[-1] == "samplerate"


def test_duck_and_mix(spark):
    own = spark.createDataFrame([("a", k, 100.0) for k in range(5)], "src string, idx long, v double")
    keys = spark.createDataFrame([("a", 2, 0.9), ("a", 2, 0.3), ("a", 3, 1.0)], "src string, idx long, v double")
    got = [r["v"] for r in mixing.duck(own, keys, 0.5, 0.8, 0.5, 0.9).orderBy("idx").collect()]
    assert np.allclose(got, [100, 100, 60, 40, 46])
    s = spark.createDataFrame([("a", 0, 0, 30000), ("a", 0, 0, 30000), ("a", 1, 0, -5)], "src string, idx long, channel int, v int")
    assert [r["v"] for r in mixing.mix_samples(s).orderBy("idx").collect()] == [32767, -5]


def test_matte_and_overlay(spark):
    m = np.array(one(spark, kernels.matte(8, 6, 2, 1, 4, 3)))
    want = np.zeros((6, 8))
    want[1:4, 2:6] = 255
    assert (m == want).all() and (np.array(one(spark, kernels.matte(8, 6, 2, 1, 4, 3, inverted=True))) == 255 - want).all()
    e = np.array(one(spark, kernels.matte(20, 20, 0, 0, 20, 20, radius=-1)))
    assert e[10, 10] == 255 and e[0, 0] == 0 and abs((e > 0).mean() - np.pi / 4) < 0.03
    soft = np.array(one(spark, kernels.matte(20, 20, 5, 5, 10, 10, feather=4)))
    assert 0 < soft[10, 4] < 255 and soft[10, 10] == 255
    px = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, kernels.overlay(px(10, 10, 10, 10), px(200, 100), px(255, 128), 1)) == [10, 200, 55, 10]


def test_frame_differences(spark, tmp_path):
    rows = [("a", k, [k % 2, 5, k]) for k in range(6)]
    for part in (0, 1):
        spark.createDataFrame(rows[part * 3 : part * 3 + 3], "src string, idx long, px array<int>").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("src string, idx long, px array<int>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = frame_differences(stream).writeStream.outputMode("append").format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {r["idx"]: round(r["moved"], 6) for r in spark.table("moved").collect()}
    assert got[0] == 0 and all(got[k] == 0.666667 for k in range(1, 6))
