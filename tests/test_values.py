import math
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions import values as V


def test_thresholds_and_times():
    assert V.threshold("0.04") == 0.04 and V.threshold("3%") == 0.03 and abs(V.threshold("-19dB") - 10 ** (-19 / 20)) < 1e-15
    for bad in ("101%", "-1", "x", "3 foo", "1dB"):
        with pytest.raises(ValueError):
            V.threshold(bad)
    assert V.time("90") == V.Time(False, 90) and V.time("1.5sec") == V.Time(True, 1500) and V.time("-2min") == V.Time(True, -120_000)
    assert V.time("end").n == (1 << 62) - 1 and V.Time(True, 1001).frames(Fraction(30000, 1001)) == 30
    assert V.Time(True, 50).frames(Fraction(30)) == 2  # 1.5 rounds away from zero
    with pytest.raises(ValueError):
        V.time("1.5")


def test_rates_and_others():
    assert V.sane_timebase(Fraction(2997, 100)) == Fraction(30000, 1001) and V.sane_timebase(Fraction(25)) == 25
    assert V.ntsc_rate(Fraction(30000, 1001)) == (30, True) and V.ntsc_rate(Fraction(25)) == (25, False)
    assert V.bitrate("1.5M") == 1_500_000 and V.colour("#0f8") == (0, 255, 136) and V.colour("white") == (255, 255, 255)
    assert V.suggestion("moton", ["audio", "motion"]) == "motion" and V.suggestion("zzzzzzzz", ["audio"]) is None
    assert V.smpte_frames("00:01:00;02", 30) == 1800 and V.smpte_frames("00:00:01:05", 25) == 30


@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_edit_distance_is_a_metric(a, b):
    d = V.edit_distance(a, b)
    assert d == V.edit_distance(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_quantize_golden(spark):
    want = {0.04: 2621, 0.02: 1311, 0.98: 64224, 0.5: 32768, 0.03: 1966, 10 ** (-19 / 20): 7353, 10 ** (-12 / 20): 16462, 2.0: 65535, -1.0: 0, float("nan"): 0}
    got = spark.createDataFrame([(x,) for x in want], "x double").select(C.u16(F.col("x"))).collect()
    assert [r[0] for r in got] == list(want.values())
    assert [one(spark, C.s16(F.lit(x))) for x in (1.0, -1.0, 0.5, -0.5, 0.0)] == [32767, -32767, 16384, -16384, 0]


def test_bounds_golden(spark):
    rows = [(0, 3, 8.0, 0, 0), (0, 4, 8.0, 0, 1), (0, 5, 8.0, 0, 1), (34, 396, 2.0, 17, 181), (7, 9, 1.5, 5, 1), (3, 4, 2.0, 2, 0)]
    df = spark.createDataFrame(rows, "a long, b long, s double, o long, d long")
    offset, dur = C.clip_bounds(F.col("a"), F.col("b"), F.col("s"))
    assert all(r[0] == r[2] and r[1] == r[3] for r in df.select(offset, dur, "o", "d").collect())


def test_buckets_and_spans(spark):
    rate, tb = 48000, Fraction(30000, 1001)
    df = spark.range(0, 3000).withColumn("b", C.bucket_start(F.col("id"), rate, tb))
    starts = [r["b"] for r in df.collect()]
    assert starts[:8] == [0, 1602, 3203, 4805, 6406, 8008, 9610, 11211]
    assert starts == [math.floor(Fraction(k) * rate / tb + Fraction(1, 2)) for k in range(3000)]
    own = spark.range(0, 20000).select("id", C.sample_bucket(F.col("id"), rate, tb).alias("k")).collect()
    assert all(starts[r["k"]] <= r["id"] < starts[r["k"] + 1] for r in own)


def test_shortest_decimal_quantizes_back(spark):
    df = spark.range(0, 65536).select(F.col("id").cast("int").alias("u")).withColumn("t", C.shortest_decimal(F.col("u")))
    assert df.where(C.u16(F.col("t").cast("double")) != F.col("u")).count() == 0
    assert df.where("u = 32768").first()["t"] == "0.5"


def test_keyframes_and_easing(spark):
    rows = spark.range(0, 7).select(F.round(C.sample_keyframes(F.array(*map(F.lit, (1.0, 0.5, 1.0))), C.clip_position(F.col("id"), F.lit(5))), 6)).collect()
    assert [r[0] for r in rows] == [1, 0.75, 0.5, 0.75, 1, 1, 1]
    rows = spark.range(0, 5).select(C.ease("inout", C.clip_position(F.col("id"), F.lit(5)))).collect()
    assert [r[0] for r in rows] == [0, 0.125, 0.5, 0.875, 1]


def test_text_functions(spark):
    assert one(spark, C.timecode(F.lit(3_599_999))) == "00:59:59.999" and one(spark, C.timecode(F.lit(59_999), "ass")) == "0:01:00.00" and one(spark, C.timecode(F.lit(59_600), "display")) == "0:01:00"
    assert one(spark, C.timecode(F.lit(1500), "srt")) == "00:00:01,500"
    line = r"0,0,Default,,0,0,0,,Hello, {\i1}you{\i0}\Nthere\hnow {open"
    assert one(spark, C.dialogue_text(F.lit(line))) == "Hello, you\nthere now {open"
    path = "/a b/ü+c%.mp4"
    assert one(spark, C.path_of_uri(C.uri_of_path(F.lit(path)))) == path and "%20" in one(spark, C.uri_of_path(F.lit(path)))
    assert one(spark, C.byte_size(F.lit(2048))) == "2.00 KiB" and one(spark, C.hex_colour(F.lit(1), F.lit(255), F.lit(16))) == "#01ff10"
    assert one(spark, C.angle_code(F.lit(-90.0))) == 49152 and abs(one(spark, C.note_hertz(F.lit(69))) - 440) < 1e-9 and len(one(spark, C.cache_key(F.lit("a"), F.lit(1)))) == 16
