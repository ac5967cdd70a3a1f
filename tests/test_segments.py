"""Masks and segments against literal forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framespan.operators import masks, segments


def mask(spark, arrays):
    return spark.createDataFrame([(s, k, v == "1") for s, a in arrays.items() for k, v in enumerate(a)], "src string, frame int, on boolean")


def text(df):
    out = {}
    for r in df.orderBy("src", "frame").collect():
        out[r["src"]] = out.get(r["src"], "") + "01"[r["on"]]
    return out


def literal_margin(a, start, end):
    out = list(a)
    n = len(a)
    for k in range(1, n):
        if a[k] == "1" and a[k - 1] == "0":
            for j in range(max(0, k - start), k) if start > 0 else range(k, min(n, k - start)):
                out[j] = "1" if start > 0 else "0"
    for k in range(1, n):
        if a[k] == "0" and a[k - 1] == "1":
            for j in range(k, min(n, k + end)) if end > 0 else range(max(0, k + end), k):
                out[j] = "1" if end > 0 else "0"
    return "".join(out)


GOLDEN = "00111000001000111100"


def test_margin_golden(spark):
    for (s, e), want in {(1, 1): "01111100011101111110", (2, 1): "11111100111111111110", (-1, 0): "00011000000000011100", (0, -1): "00110000000000111000", (2, -1): "11110000110011111000"}.items():
        assert literal_margin(GOLDEN, s, e) == want
        assert text(segments.margin(mask(spark, {"a": GOLDEN}), s, e)) == {"a": want}


@pytest.mark.parametrize("rule", [(3, 2), (-2, -2), (1, -3), (-1, 4), (0, 0)])
def test_margin_random(spark, rule):
    rng = random.Random(str(rule))
    arrays = {f"s{k}": "".join(rng.choice("01") for _ in range(rng.randint(1, 40))) for k in range(60)}
    assert text(segments.margin(mask(spark, arrays), *rule)) == {k: literal_margin(a, *rule) for k, a in arrays.items()}


def literal_smooth(a, min_cut, min_clip):
    state, before = a, None
    while True:
        new = "".join(("0" if v == "1" else "1") * (e - s) if e - s < (min_clip if v == "1" else min_cut) else v * (e - s) for s, e, v in segments.iterate_chunks(list(state)))
        if new in (state, before):
            return new
        state, before = new, state


def test_smooth(spark):
    rng = random.Random(2)
    arrays = {f"s{k}": "".join(rng.choice("0011") for _ in range(rng.randint(1, 40))) for k in range(80)} | {"one": "1", "alt": "101010"}
    own = mask(spark, arrays)
    for rule in ((0, 0), (3, 2), (4, 4), (5, 5)):
        got = segments.smooth(segments.runs(own), *rule)
        assert text(segments.frames_of(got)) == {k: literal_smooth(a, *rule) for k, a in arrays.items()}
    assert literal_smooth("1", 5, 5) == "1" and literal_smooth("01111100011101111110", 3, 2) == "11111100011111111111"


def test_laws_of_unequal_lengths(spark):
    a, b, none = (mask(spark, {"x": t}) for t in ("101", "01010", ""))
    assert text(masks.any_of([a, b])) == {"x": "11110"} and text(masks.odd_of([a, b])) == {"x": "11110"} and text(masks.all_of([a, b])) == {"x": "000"}
    assert text(masks.none_of(a)) == {"x": "010"} and text(masks.any_of([a, none])) == {"x": "101"} and text(masks.all_of([a, none])) == {} and text(masks.none_of(none)) == {}


def test_runs_and_back(spark):
    own = mask(spark, {"a": "0011100", "b": "1"})
    assert {(r["src"], r["start"], r["end"], r["on"]) for r in segments.runs(own).collect()} == {("a", 0, 2, False), ("a", 2, 5, True), ("a", 5, 7, False), ("b", 0, 1, True)}
    assert text(segments.frames_of(segments.runs(own))) == {"a": "0011100", "b": "1"}


def test_overrides_extend_and_the_last_wins(spark):
    labels = mask(spark, {"a": "0000011111"}).select("src", "frame", F.col("on").cast("int").alias("label"))
    ranges = spark.createDataFrame([(0, 2, 6, 5), (1, 4, 8, 6), (2, -2, 1 << 61, 7)], "seq int, start long, stop long, action int")
    lengths = spark.createDataFrame([("a", 14)], "src string, length long")
    got = [r["action"] for r in segments.override(labels, ranges, lengths).orderBy("frame").collect()]
    assert got == [0, 0, 5, 5, 6, 6, 6, 6, 1, 1, 0, 0, 7, 7]


def test_cue_masks_spell_out_runs_without_a_join(spark):
    rng = random.Random(5)
    rows = [(f"s{k % 30}", a := rng.randint(-20, 400) / 4, a + rng.randint(-1, 60) / 4, rng.choice(["the cat", "a cat", "THE", "", None])) for k in range(400)]
    rows += [("long", 0.0, 70000.0, "none"), ("long", 69000.0, 69001.5, "the"), ("off", 2.0, 3.0, "none"), ("before", -9.0, -2.0, "the"), (None, 0.0, 3.0, "the")]
    want = {}
    for src in {r[0] for r in rows}:
        real = [r for r in rows if r[0] == src and r[3] is not None and r[2] > r[1]]
        on = {f for _, a, b, t in real if "the" in t.lower() and src for f in range(math.floor(a), math.ceil(b))}
        want |= {(src, f): f in on for f in range(max((math.ceil(r[2]) for r in real), default=0))}
    df = masks.cue_mask(spark.createDataFrame(rows, "src string, start double, end double, text string"), masks.word_pattern("the"), True)
    got = [((r["src"], r["frame"]), r["on"]) for r in df.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()  # the frames of all sources were broadcast where the table is a small file
