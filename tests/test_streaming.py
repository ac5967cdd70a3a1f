from framespan.streaming.gate import gate, gate_batch, gate_stream, tumbling


def test_gate_rule():
    loud = lambda s: [(k, c == "1") for k, c in enumerate(s)]
    found, state = gate(loud("0001110000" + "1" + "0000" + "111111"), (-1, -1, 0, -1), silence=3, least=2, preroll=2, longest=100)
    assert found == [(1, 8, 3)] and state[0] == 13
    found, _ = gate(loud("1" * 25), (-1, -1, 0, -1), silence=3, least=2, preroll=2, longest=10)
    assert [e - s for s, e, _ in found][:2] == [9, 10] or [e - s for s, e, _ in found][0] >= 9


def test_gate_in_parts_equals_the_whole():
    import random

    rng = random.Random(4)
    rows = [(k, rng.random() < 0.3) for k in range(2000)]
    whole, _ = gate(rows, (-1, -1, 0, -1), silence=4, least=2, preroll=2, longest=40)
    state, parts = (-1, -1, 0, -1), []
    for low in range(0, 2000, 77):
        found, state = gate(rows[low : low + 77], state, silence=4, least=2, preroll=2, longest=40)
        parts += found
    assert parts == whole and whole


def test_gate_batch(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 5, 20, 22, 24, 60)] + [("b", 1)], "k string, t long")
    assert sorted(tuple(r) for r in gate_batch(rows, "k", 5, 2).collect()) == [("a", 0, 5, 2), ("a", 20, 24, 3)]


def test_gate_stream(spark, tmp_path):
    import random

    rng = random.Random(9)
    data = {s: [(k, rng.random() < 0.3) for k in range(600)] for s in ("a", "b")}
    for part in range(3):
        rows = [(s, k, v) for s, own in data.items() for k, v in own[part * 200 : part * 200 + 200]]
        spark.createDataFrame(rows, "src string, idx long, loud boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("src string, idx long, loud boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = gate_stream(stream, silence=4, least=2, preroll=2, longest=40).writeStream.outputMode("append").format("memory").queryName("gates").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    want = {(s, *g) for s, own in data.items() for g in gate(own, (-1, -1, 0, -1), silence=4, least=2, preroll=2, longest=40)[0]}
    assert {tuple(r) for r in spark.table("gates").collect()} == want


def test_tumbling(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("a", at(1), 2.0), ("a", at(8), -7.0), ("a", at(11), 1.0), ("a", at(100), 0.0)], "src string, ts timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("src string, ts timestamp, v double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = tumbling(stream, "ts", "v", "10 seconds", "5 seconds").writeStream.outputMode("append").format("memory").queryName("tops").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["top"] for r in spark.table("tops").collect()) == [1.0, 7.0]
