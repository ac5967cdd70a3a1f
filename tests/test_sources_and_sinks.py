import json
import random
import struct
import wave
from fractions import Fraction
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framespan import queries_more
from framespan.functions import values as V
from framespan.operators import kernels, mixing, transitions
from framespan.queries import QUERIES
from framespan.sinks import dumps, editors, timeline_json
from framespan.sources import media, subtitles, timeline_json as reader, wav, xmeml


@pytest.fixture(scope="module")
def clips(spark):
    rows = [("t", k, 0, n, s, d, o, m, v) for k in ("v", "a") for n, (s, d, o, m, v) in enumerate([(0, 40, 20, "/m/a b.mp4", 1.0), (40, 30, 90, "/m/a b.mp4", 1.0), (80, 20, 10, "/m/c.mp4", 2.0)])]
    return spark.createDataFrame(rows, "src string, kind string, layer int, ord long, start long, dur long, offset long, media string, speed double")


@pytest.fixture(scope="module")
def fades(spark, clips):
    t = transitions.dissolves(clips.withColumn("track", F.struct("src", "kind", "layer")), 10, 0)
    return t.select("track.src", "track.kind", "track.layer", "ord", "at", "dur", "alignment")


def test_dissolves_by_hand(fades):
    got = {(r["at"], r["dur"], r["alignment"]) for r in fades.where("kind = 'v'").collect()}
    assert got == {(0, 10, "start"), (40, 10, "center"), (100, 10, "end")}


@pytest.mark.parametrize("kind", sorted(editors.WRITERS))
def test_documents(clips, fades, kind):
    text = editors.documents(clips, fades, kind, Fraction(30000, 1001), {"/m/a b.mp4": 300, "/m/c.mp4": 100}).first()["document"]
    if kind == "otio":
        tracks = json.loads(text)["tracks"]["children"]
        names = [c["OTIO_SCHEMA"] for c in tracks[0]["children"]]
        assert names == ["Transition.1", "Clip.2", "Transition.1", "Clip.2", "Gap.1", "Clip.2", "Transition.1"]
        assert tracks[0]["children"][4]["source_range"]["duration"]["value"] == 10
        assert tracks[0]["children"][1]["metadata"] == tracks[1]["children"][1]["metadata"]
        return
    root = ET.fromstring(text)
    if kind == "final-cut-pro":
        assert [c.tag for c in root.iter("spine")][0] == "spine"
        assert [e.tag for e in root.find(".//spine")] == ["transition", "asset-clip", "transition", "asset-clip", "asset-clip", "transition"]
        assert root.find(".//asset-clip").get("start") == "20020/30000s" and root.find(".//timeMap") is not None
    elif kind in ("premiere", "resolve-fcp7"):
        assert root.findtext(".//ntsc") == "TRUE" and root.findtext(".//timebase") == "30"
        assert len(root.findall(".//pathurl")) == 2 and len(root.findall(".//clipitem")) == 6 and len(root.findall(".//transitionitem")) == 6
    elif kind == "kdenlive":
        lists = root.findall("playlist")
        assert len(lists) == 4 and [len(p.findall("entry")) for p in lists] == [1, 2, 1, 2]
    else:
        assert len(root.findall("playlist")) == 2 and len([t for t in root.findall("tractor") if t.get("id").startswith("transition")]) == 2


def test_documents_of_many_timelines_across_batches(spark):
    """A timeline whose clips come in several batches, beside short ones; nothing is grouped in pandas, which costs milliseconds a timeline."""
    rows = [(f"t{k}" if k else None, "v", layer, n, n * 10, 10, n * 20, f"/m/{n % 3}.mp4", 1.0) for k in range(40) for layer in (0, 1) for n in range(25 if k == 7 else 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "src string, kind string, layer int, ord long, start long, dur long, offset long, media string, speed double")
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(most, 3)
    try:
        docs = editors.documents(df, None, "otio", Fraction(30))
        got = {r["src"]: json.loads(r["document"]) for r in docs.collect()}
    finally:
        spark.conf.unset(most)
    assert len(got) == 40
    for src, doc in got.items():
        want = [[r[6] for r in sorted(rows, key=lambda r: r[3]) if r[0] == src and r[2] == layer] for layer in (0, 1)]
        assert doc["name"] == str(src) and [[c["source_range"]["start_time"]["value"] for c in t["children"]] for t in doc["tracks"]["children"]] == want
    assert "InPandas" not in docs._jdf.queryExecution().executedPlan().toString()


def test_text_of_documents_is_escaped():
    odd = """/m/a&b<c>"d'\té.mp4"""
    text = editors.kdenlive(editors.Timeline("t", Fraction(25), {("v", 0): [editors.Clip(0, 5, 0, odd)]}))
    root = ET.fromstring(text)
    assert root.find("chain/property").text == odd and root.find("playlist/entry").get("producer") == "chain0"
    root = ET.fromstring(editors.xmeml(editors.Timeline(odd, Fraction(25), {("v", 0): [editors.Clip(0, 5, 0, odd)]})))
    assert root.findtext("sequence/name") == odd and root.findtext(".//file/name") == odd.removeprefix("/m/")


@pytest.mark.parametrize("name", ["q_fcpxml", "q_kdenlive", "q_shotcut", "q_otio", "q_stereo_tracks", "q_xmeml_round_trip"])
def test_queries_of_documents_group_nothing_in_pandas(spark, name):
    assert "InPandas" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_shotcut_documents_are_sent_and_searched_once(spark):
    """Clips without transitions go to Python without columns of them; entries are looked for in one search of a document."""
    plan = QUERIES["q_shotcut"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(document") == 1 and "incoming" not in plan and "outgoing" not in plan


def test_entries_of_documents_of_any_length(spark):
    """Times of seconds, minutes, hours, and of a hundred hours and more."""
    for kind in ("shotcut", "kdenlive"):
        spans = [(0, 10), (1, 1500), (1503, 90_000), (90_007, 1), (9_000_011, 30), (25_000_013, 9_000_000)]
        t = editors.Timeline("t", Fraction(25), {(k, 0): [editors.Clip(sum(d for _, d in spans[:n]), d, o, '/m/"a>.mp4') for n, (o, d) in enumerate(spans)] for k in "va"})
        docs = spark.createDataFrame([("t", editors.WRITERS[kind](t)), ("none", editors.WRITERS[kind](editors.Timeline("none", Fraction(25), {})))], "src string, document string")
        got = {r["src"]: tuple(r)[1:] for r in queries_more._entries(docs).collect()}
        assert got == {"t": (12, 2 * 40 * sum(o for o, _ in spans), 2 * 40 * sum(o + d - 1 for o, d in spans)), "none": (0, 0, 0)}


def test_values_of_columns():
    """Numbers and texts of a batch as they were, with nulls."""
    for values, kind in (([3, 1, 3], pa.int64()), ([3, None], pa.int32()), ([1.5, None], pa.float64()), (["b", None, "a", "b", ""], pa.string()), ([], pa.string()), ([None], pa.string()), ([True, None], pa.bool_()), ([{"a": 1}, None], pa.struct([("a", pa.int64())]))):
        assert editors._values(pa.array(values, kind)) == values
    whole = pa.array(["a", "b", None, "b"] * 2)
    assert editors._values(whole.slice(1, 5)) == ["b", None, "b", "a", "b"] and editors._values(pa.array(range(9)).slice(4, 3)) == [4, 5, 6]


def test_times_are_rounded_as_fractions():
    for rate in (Fraction(30000, 1001), Fraction(25), Fraction(2997, 100), Fraction(16), Fraction(24000, 1001)):
        for n in (-7, -1, 0, 1, 2, 29, 1001, 30000, 123_457, 10_000_001):
            ms = V.half_away(Fraction(n) / rate * 1000)
            want = f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
            assert editors._clock(editors.Timeline("t", rate, {}))(n) == want


def test_xmeml_round_trip(spark, clips):
    docs = editors.documents(clips, None, "premiere", Fraction(30))
    back = xmeml.read_xmeml(docs)
    key = lambda r: (r["kind"], r["ord"], r["start"], r["dur"], r["offset"], r["media"])
    assert {key(r) for r in back.collect()} == {key(r) for r in clips.collect()}
    assert [r["effects"] for r in back.where("kind = 'v' and ord = 2").collect()] == [["speed:2"]]
    assert xmeml.path_of("file://localhost/a%20b+c") == "/a b+c"


def test_json_versions(spark, clips):
    chunks = spark.createDataFrame([("s", 0, 30, 1.0), ("s", 30, 60, None), ("s", 60, 68, 8.0), ("s", 68, 72, 8.0)], "src string, start long, end long, speed double")
    doc = timeline_json.v1_json(chunks, "30/1")
    assert json.loads(doc.first()["json"])["chunks"] == [[0, 30, 1], [30, 60, 99999], [60, 68, 8], [68, 72, 8]]
    assert [(r["start"], r["dur"], r["offset"]) for r in reader.read_v1(doc, "json").orderBy("ord").collect()] == [(0, 30, 0), (30, 1, 8)]
    two = spark.createDataFrame([("s", 0, 10, ["nil"]), ("s", 10, 30, ["cut"]), ("s", 30, 50, ["speed:2"]), ("s", 50, 60, ["nil"])], "src string, start long, end long, effects array<string>")
    doc = timeline_json.v2_json(two, "30/1")
    parsed = json.loads(doc.first()["json"])
    assert parsed["effects"] == [["nil"], ["cut"], ["speed:2"]] and parsed["clips"] == [[0, 10, 0], [10, 30, 1], [30, 50, 2], [50, 60, 0]]
    assert [(r["start"], r["dur"], r["effects"]) for r in reader.read_v2(doc, "json").orderBy("ord").collect()] == [(0, 10, 0), (10, 10, 1), (20, 10, 0)]
    rows = clips.select("src", "kind", "layer", "ord", "start", "dur", "offset", F.lit(0).alias("stream"), F.array(F.lit("nil")).alias("effects"))
    t = spark.createDataFrame([("t", "v", 0, 40, 10, "center")], "src string, kind string, layer int, at long, dur long, alignment string")
    doc = timeline_json.v3_json(rows, "30/1", transitions=t)
    assert reader.read_v3(doc, "json").count() == 6 and [r["at"] for r in reader.read_transitions(doc, "json").collect()] == [40]
    bad = spark.createDataFrame([("s", '{"version":"3","v":[[{"src":"a","start":0,"dur":0,"offset":0}]]}')], "src string, json string")
    with pytest.raises(Exception, match="positive dur"):
        reader.read_v3(bad, "json").collect()


def test_subtitles(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nyou\r\n\r\n2\r\n00:00:03,000 --> 00:00:03,000\r\nnever\r\n\r\n00:01:00.250 --> 01:00:00.000\nlast\n"
    ass = "[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,A {\\b1}bold{\\b0}, word\\Nnext\nComment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,no\n"
    files = spark.createDataFrame([("s", srt)], "src string, content string")
    assert [(r[1], r[2], r[3]) for r in subtitles.read_srt(files).orderBy("start_ms").collect()] == [(1000, 2500, "Hello\nyou"), (60250, 3600000, "last")]
    files = spark.createDataFrame([("s", ass)], "src string, content string")
    assert [tuple(r) for r in subtitles.read_ass(files).collect()] == [("s", 1500, 2000, "A bold, word\nnext")]
    segments = spark.createDataFrame([("s", 0, 900, "hi  there"), ("s", 1000, 1500, "[BLANK_AUDIO]")], "src string, start_ms long, end_ms long, text string")
    assert [r["text"] for r in dumps.transcript(dumps.clean_transcript(segments), "srt").collect()] == ["1\n00:00:00,000 --> 00:00:00,900\nhi there\n"]
    assert json.loads(dumps.transcript(segments, "json").first()["text"])["end"] == 900
    own = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "src string, stream int, text string")
    count = spark.createDataFrame([("a", 2), ("b", 1)], "src string, n int")
    side = spark.createDataFrame([("a", 0, "no"), ("b", 0, "z"), ("b", 1, "no")], "src string, stream int, text string")
    assert sorted(tuple(r) for r in subtitles.with_sidecars(own, count, side, 1).collect()) == [("a", "y"), ("b", "z")]


def test_wav(spark, tmp_path):
    data = np.array([[0, 100], [-32768, 32767], [5, -5]], "<i2")
    for width, name in ((2, "two"), (3, "three")):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(data.tobytes() if width == 2 else b"".join(b"\x7f" + struct.pack("<h", v) for v in data.ravel()))
    rows = wav.samples(wav.read_wav(spark, str(tmp_path)))
    for name in ("two", "three"):
        got = {(r["channel"], r["idx"]): r["v"] for r in rows.where(F.col("src").contains(name)).collect()}
        assert got == {(c, i): int(data[i, c]) for c in (0, 1) for i in range(3)}
    assert [r["v"] for r in wav.sample_range(rows.where(F.col("src").contains("two") & (F.col("channel") == 0)), 1, 5).orderBy("idx").collect()] == [-32768, 5, 0, 0]


def test_media(spark):
    rows = [("/a.mp4", 10.0, 1000, [("h264", 2997, 100, 1280, 720, 10.0, "eng")], [("aac", "stereo", 48000, 2, 10.0, None), ("aac", "mono", 48000, 1, 10.0, "deu")], [], [], []), ("/b.wav", 5.0, 500, [], [("pcm", "mono", 44100, 1, 5.0, None)], [], [], [])]
    df = spark.createDataFrame(rows, media.SCHEMA)
    assert {r["path"]: r["timebase"] for r in media.recommended_timebase(df).collect()} == {"/a.mp4": "30000/1001", "/b.wav": "30/1"}
    assert media.streams(df).count() == 4 and json.loads(media.info_json(df).where("path = '/b.wav'").first()["json"])["audio"][0]["layout"] == "mono"
    one = spark.createDataFrame([("/a.mp4", 0, 10)], "media string, start long, dur long")
    assert sorted((r["kind"], r["layer"]) for r in media.fan_out(one, df).collect()) == [("a", 0), ("a", 1), ("v", 0)]
    assert spark.range(1).select(media.nearest_rate(F.lit(46000))).first()[0] == 44100


def test_level_cache(spark, tmp_path):
    path = media.level_cache_path(str(tmp_path), ("a.mp4", "30/1", "audio"), "audio")
    calls = []
    make = lambda: calls.append(1) or spark.range(50).withColumnRenamed("id", "u16")
    assert media.cached_levels(spark, path, make).count() == 50 and media.cached_levels(spark, path, make).count() == 50 and len(calls) == 1


def test_dumps(spark):
    levels = spark.createDataFrame([("a", 0, 32768), ("a", 1, 0)], "src string, frame int, u16 int")
    assert [r["text"] for r in dumps.level_lines(levels).orderBy("line").collect()] == ["@start", "0.5", "0.0", ""]
    assert [r["text"] for r in dumps.level_lines(levels, raw=True).orderBy("line").collect()] == ["@start", "32768", "0", ""]
    wave_ = spark.createDataFrame([("a", 0, -3.0, 4.0), ("a", 256, 0.0, 1.0)], "src string, bucket_start long, lo double, hi double")
    assert [r["text"] for r in dumps.waveform_lines(wave_).orderBy("line").collect()] == ["@start", "@offset 0", "-3,4", "0,1"]
    assert dumps.altered_name("a.b.srt") == "a.b_ALTERED.srt"
    cache = spark.createDataFrame([(f"f{k}", k) for k in range(260)], "path string, mtime long")
    assert [r["path"] for r in dumps.keep_newest(cache).collect()] == ["f0", "f1", "f2", "f3", "f4"]


def test_kernels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    px = F.array(*map(F.lit, (10, 200, 30, 250)))
    assert one(kernels.invert(px)) == [245, 55, 225, 5] and one(kernels.hflip(px)) == [250, 30, 200, 10] and one(kernels.brightness(px, 0.2)) == [61, 251, 81, 255]
    assert one(kernels.erosion(px)) == [10, 10, 30, 30] and one(kernels.pixelate(px, 2)) == [105, 105, 140, 140] and one(kernels.choke(px, 2)) == [10, 10, 10, 30]
    assert one(kernels.aberration(px, 1)) == [10, 10, 200, 30] and one(kernels.aberration(px, 1, wrap=True)) == [250, 10, 200, 30]
    assert one(kernels.opacity(px, 0.5)) == [5, 100, 15, 125] and one(kernels.key_out(px, 200, 0.1)) == [10, 0, 30, 250] and one(kernels.contrast(px, 2.0)) == [0, 255, 0, 255]
    assert one(kernels.volume(F.array(F.lit(1), F.lit(30000), F.lit(-30000)), 1.5)) == [2, 32767, -32768]
    tone = one(kernels.tone(F.lit(69), F.lit(100), 48000))
    assert len(tone) == 100 and max(map(abs, tone)) <= 8191 and tone[0] == 0
    env = one(mixing.envelope(F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0))), 0.5, 0.2, 0.5, 0.9))
    assert np.allclose(env, [1.0, 0.6, 0.4, 0.46])
    assert one(kernels.loop_index(F.lit(13), F.lit(5))) == 3


def test_ramps_of_points():
    """The values, spread evenly and read as a line again, are those of the points at every frame."""
    rng = np.random.default_rng(4)
    assert xmeml.ramp([(0.0, 1.0)], 0, 10) == [1.0] == xmeml.ramp([(3.0, 1.0), (8.0, 1.0)], 0, 10)
    assert xmeml.ramp([(0.0, 50.0), (100.0, 100.0)], 0, 101) == [50.0, 100.0]
    assert xmeml.ramp([(100.0, 3.0), (0.0, 1.0), (50.0, 5.0)], 0, 101) == [1.0, 5.0, 3.0]
    assert xmeml.ramp([(0.0, 0.0), (50.0, 1.0), (99.0, 0.0)], 0, 100) == [0.0, 1.0, 0.0]  # the middle is half a frame off
    assert len(xmeml.ramp([(0.0, 0.0), (30.0, 1.0)], 0, 101)) == 11
    for _ in range(200):
        begin, frames = float(rng.integers(0, 50)), int(rng.integers(2, 400))
        times = rng.choice(np.arange(-5, frames + 5), min(int(rng.integers(2, 7)), frames), replace=False) + begin
        points = [(float(t), float(v)) for t, v in zip(times, rng.integers(0, 100, len(times)))]
        values = xmeml.ramp(points, begin, frames)
        assert 1 <= len(values) <= xmeml.MAX_VALUES
        every = begin + np.arange(frames)
        own = dict(sorted(points))
        want = np.interp(every, [*own], [*own.values()])
        got = np.interp(np.linspace(0, 1, frames), np.linspace(0, 1, len(values)), values) if len(values) > 1 else np.full(frames, values[0])
        steepest = max(np.abs(np.diff(want)).max(), np.abs(np.diff([*own.values()]) / np.diff([*own])).max())
        assert np.abs(got - want).max() <= steepest * max(1.0, frames / 255) + 1e-9
