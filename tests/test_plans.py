from fractions import Fraction

import pytest

from framespan.functions.values import Time
from framespan.operators import masks
from framespan.plans import actions as A
from framespan.plans import edit_language as L
from framespan.plans import flags as G


def test_parse_forms():
    a = L.parse('(or audio:3% [not (motion 0.02 stream)] {word "two words"}) ; comment')
    assert a.name == "or" and [x.name for x in a.args] == ["audio", "not", "word"]
    assert L.parse("or audio:3% motion:6%").args[1].args[0].text == "6%"
    b = L.parse("audio:threshold=-19dB,stream=1")
    assert L.bind(b) == {"threshold": "-19dB", "stream": "1", "channel": "all"}
    assert L.bind(L.parse("audio"))["threshold"] == "0.04"
    assert L.parse(r'regex:"a\"b\n"').args[0].text == 'a"b\n'


@pytest.mark.parametrize("bad", ["", "(", "(or", "or audio)", "(or]", "audio:1,2,3,4", "audio:threshold=1,threshold=2", "audio:stream=1,2", "audio:nope=1", "moton", "word", '"x" audio'])
def test_bad_expressions(bad):
    with pytest.raises(L.EditError):
        node = L.parse(bad)
        L.bind(node)


def test_media_needed():
    assert L.media_needed(L.parse("(or audio (not motion))")) == {"audio", "video"}
    assert L.media_needed(L.parse("none")) == set() and L.media_needed(L.parse("word:hi")) == {"subtitle"}


def test_compile(spark):
    lv = lambda xs: spark.createDataFrame([("a", k, x) for k, x in enumerate(xs)], "src string, frame int, u16 int")
    own = {"audio": lv([0, 60000, 60000, 0]), "motion": lv([60000, 0, 60000])}
    cues = spark.createDataFrame([("a", 1.0, 2.5, "Hello there"), ("a", 3.0, 4.0, "other"), ("a", 5.0, 5.0, "hello")], "src string, start double, end double, text string")
    context = L.Context(lambda m, b: own[m], spark.createDataFrame([("a", 4)], "src string, length int"), lambda stream: cues)

    def run(t):
        return "".join("01"[r["on"]] for r in L.compile_mask(L.parse(t), context).orderBy("frame").collect())

    assert run("audio") == "0110" and run("motion") == "101" and run("(and audio motion)") == "001" and run("xor audio motion") == "1100" and run("not audio") == "1001"
    assert run("none") == "1111" and run("all") == "" and run("(or all audio)") == "0110" and run("(and all audio)") == ""
    assert run("word:hello") == "0110" and run("word:hello,ignore-case=#f") == "0000" and run('regex:"o.*r"') == "0111"
    labels = L.compile_labels({1: "audio", 7: "motion:50%"}, context).orderBy("frame").collect()
    assert [r["label"] for r in labels] == [7, 1, 7, 0]
    with pytest.raises(L.EditError):
        L.compile_labels({256: "audio"}, context)
    assert masks.word_pattern("a.b") == r"\ba\.b\b"


def test_actions():
    canon = lambda t: A.canonical(A.parse_list(t))
    assert canon("nil") == "nil" and canon("speed:2,cut,volume:3") == "cut" and canon("volume:0.5,loop") == "loop,volume:0.5"
    assert canon("ease:in:2sec,zoom:1..2,opacity:0..1:ease=out") == "zoom:1..2:ease=in:2sec,opacity:0..1:ease=out"
    assert canon("contrast:1.5,saturation:2,contrast:1") == "saturation:2"
    assert A.speed(A.parse_list("speed:2,varispeed:1.5")) == 3 and A.speed(A.parse_list("cut")) is None
    rate, tempo = A.fused_chain(A.parse_list("speed:2,pitch:12"))
    assert abs(rate - 2) < 1e-12 and abs(tempo - 1) < 1e-12
    for text in ("invert", "mask:1:2:3:4", "mask:x=1:y=2:w=3:h=4:radius=-1:invert", "confine", "deesser:0.3", "duck", "lens", "tone:60:saw", "rotate:450", "spin:90/2", "drawbox:0:0:5:5:red", "colorkey:#0f0", "choke", "pixelate:8", "confetti:count=10:no-shimmer", "aberration:3", "pos:0..10:5:1:ease=in", "blur:4", "volume:2", "pitch:-3", "brighthue:0.1"):
        assert A.parse(str(A.parse(text))) == A.parse(text)
    for bad in ("nope", "speed:0", "speed", "opacity:2", "zoom:0", "mask:1:2:0:4", "tone:128", "choke:17", "pitch:25", "confetti:count=1:count=2", "pos:1", "zoom:" + "..".join(["1"] * 256), "ease"):
        with pytest.raises(A.ActionError):
            A.parse_list(bad) if bad == "ease" else A.parse(bad)
    assert A.overlay_spec("add:C:/a.png:10:20:0.5:follow-base=0") == {"path": "C:/a.png", "follow_base": False, "pos": ((10.0,), (20.0,), (0.5,))}
    assert A.overlay_spec("add:x:5")["path"] == "x:5"


def test_flags():
    own = G.overrides([("cut", "0,10"), ("set-speed", "2,5sec,end"), ("keep", "-20,-1"), ("set-action", "volume:2,invert,1,3")])
    assert [o.action for o in own] == ["cut", "speed:2", "nil", "volume:2,invert"] and own[1].start == Time(True, 5000)
    rows, index = G.action_table({}, own)
    assert rows[0][1:] == ("cut", None) and rows[1][1:] == ("nil", 1.0) and index == {0: 0, 1: 2, 2: 1, 3: 3}
    assert own[1].row(Fraction(30), 2)[2] == 150
    assert G.transition("dissolve:1sec:3")[2] == Time(False, 3) and G.normalizer("ebu:-20,tp=-3")["tp"] == -3 and G.normalizer("peak:-6")["t"] == -6
    assert G.export('premiere:name="a, b",version=11') == ("premiere", {"name": "a, b", "version": "11"}) and G.export(None, "x.otio")[0] == "otio"
    assert G.labelled("7") == 7
    for bad in (lambda: G.labelled("256"), lambda: G.normalizer("ebu:9"), lambda: G.export("nope"), lambda: G.transition("wipe:3"), lambda: G.time_range("1")):
        with pytest.raises(ValueError):
            bad()
