"""Shards of near equal bytes by a histogram sort, in DataFrame operations only.

Rows are ordered by a hash of their text, then by document id, then by the place where they
were read, so copies of a text lie side by side and a group of copies that is larger than a
shard can still be cut. Splitters are found by counting the exact bytes below evenly spaced
boundaries, and again between the two boundaries around each target, until every splitter
is within the tolerance or next to a single row. Then the rows are exchanged once.

The driver finds the splitters of shards and of up to ``PIECES`` pieces of them. What is larger
than a task should be is cut further by arithmetic: a piece's range of keys is divided evenly,
so tasks are as many as the input needs whatever its size.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.llm.storage import Workspace

SHARDS, ROW_BYTES = 24, 8
#: Boundaries probed in a bracket, and the part of a piece's bytes by which a splitter may be off.
PROBES, TOLERANCE = 4096, 0.001
#: Bytes that one group of the exchange should have; a task takes several.
PIECE_BYTES = 32 << 20
#: Pieces whose splitters the driver looks for; larger inputs divide each of them evenly.
PIECES = 6144
_HASH_BITS = 60
_LEVELS = ("h", "dh", "dl", "rid")
_LOWEST = (0, -(1 << 40), -1, -1)


def _splitters(work: Workspace, rows: DataFrame, targets: list[float], total: int, slack: float) -> list[tuple]:
    """For each target the least key (h, dh, dl, rid) of what lies behind it."""
    spark = rows.sparkSession
    found: dict[int, tuple] = {}
    brackets = {0: {"level": 0, "prefix": (), "lo": 0, "hi": 1 << _HASH_BITS, "below": 0, "targets": list(range(len(targets)))}}
    inside = rows.withColumn("b", F.lit(0))
    extremes = [f(c).alias(f"{n}_{c}") for c in _LEVELS for n, f in (("lo", F.min), ("hi", F.max))]
    while brackets:
        for b in brackets.values():
            b["width"] = -(-(b["hi"] - b["lo"]) // PROBES)
        # One row for each bracket, of which there are at most as many as splitters.
        plan = spark.createDataFrame([(k, b["level"], b["lo"], b["width"]) for k, b in brackets.items()], "b int, level int, lo long, width long")
        key = F.when(F.col("level") == 0, F.col("h"))
        for level, c in enumerate(_LEVELS[1:], 1):
            key = key.when(F.col("level") == level, F.col(c))
        binned = inside.join(F.broadcast(plan), "b").withColumn("x", key - F.col("lo"))
        binned = binned.withColumn("bin", F.expr("cast(x div width as int)")).drop("level", "lo", "width", "x")
        bins: dict[int, list] = {k: [] for k in brackets}
        for r in binned.groupBy("b", "bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *extremes).collect():
            bins[r["b"]].append(r)
        following, edges = {}, []
        for k, b in brackets.items():
            own = sorted(bins[k], key=lambda r: r["bin"])
            ends = [b["below"] + x for x in accumulate(r["bytes"] for r in own)]
            opened: dict[int, int] = {}
            for t in b["targets"]:
                at = min(bisect_right(ends, targets[t]), len(own) - 1)
                r, before, after = own[at], ends[at] - own[at]["bytes"], ends[at]
                low = b["lo"] + r["bin"] * b["width"]
                if r["n"] == 1 or min(targets[t] - before, after - targets[t]) <= slack:
                    edge = low if targets[t] - before <= after - targets[t] else low + b["width"]
                    found[t] = (*b["prefix"], edge, *_LOWEST[len(b["prefix"]) + 1 :])
                    continue
                if at not in opened:
                    opened[at] = len(following)
                    level, prefix = b["level"], b["prefix"]
                    while r[f"lo_{_LEVELS[level]}"] == r[f"hi_{_LEVELS[level]}"]:
                        prefix, level = (*prefix, r[f"lo_{_LEVELS[level]}"]), level + 1
                    edges.append((k, r["bin"], opened[at]))
                    following[opened[at]] = {"level": level, "prefix": prefix, "lo": r[f"lo_{_LEVELS[level]}"], "hi": r[f"hi_{_LEVELS[level]}"] + 1, "below": before, "targets": []}
                following[opened[at]]["targets"].append(t)
        brackets = following
        if brackets:
            chosen = spark.createDataFrame(edges, "b int, bin int, next int")
            inside = work.write(binned.join(F.broadcast(chosen), ["b", "bin"]).select(*_LEVELS, "size", F.col("next").alias("b")), "inside")
    return [found[t] for t in range(len(targets))]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, payload: tuple[str, ...] = ()) -> DataFrame:
    """All rows of ``docs`` in ``shards`` shards of near equal bytes, with gapless slots from 0.

    A row's size is the UTF-8 bytes of ``text`` (null: none) plus 8. Returns doc_id, size,
    text_crc32, shard, slot and the columns in ``payload``. Null ids come first among copies;
    repeated rows are told apart by where they were read; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "sharding")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(
        doc.alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - _HASH_BITS).alias("h"),
        F.coalesce(F.shiftright(doc, 32), F.lit(-(1 << 33))).alias("dh"),
        F.coalesce(doc.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0).cast("long")).alias("dl"),
        F.monotonically_increasing_id().alias("rid"),
        *(F.col(c).alias(f"p_{c}") for c in payload),
    )
    rows = work.write(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PIECE_BYTES)
    per = max(1, min(-(-wanted // shards), PIECES // shards))
    pieces = per * shards
    parts = max(1, -(-wanted // pieces))
    keys = rows.select(*_LEVELS, "size")
    targets = [total * k / pieces for k in range(1, pieces)]
    splitters = _splitters(work, keys, targets, total, TOLERANCE * total / pieces) if total else []

    # How many splitters lie below each of 4096 ranges of the hash, and those within it.
    width = (1 << _HASH_BITS) // PROBES
    within: dict[int, list] = {}
    for s in sorted(splitters):
        within.setdefault(min(s[0] // width, PROBES - 1), []).append(s)
    base, lookup = 0, []
    for r in range(PROBES):
        lookup.append((r, base, within.get(r, [])))
        base += len(within.get(r, []))
    ranges = spark.createDataFrame(lookup, "range int, base int, inner array<struct<h:long,dh:long,dl:long,rid:long>>")
    own = F.struct(*_LEVELS)
    placed = rows.withColumn("range", F.shiftright("h", _HASH_BITS - 12).cast("int")).join(F.broadcast(ranges), "range")
    placed = placed.withColumn("piece", F.col("base") + F.size(F.filter("inner", lambda s: s <= own))).drop("range", "base", "inner")

    # Parts of a piece: its keys differ first in one of the levels, whose range is divided evenly.
    placed = placed.join(F.broadcast(spark.createDataFrame(_divisions(sorted(splitters), pieces, parts), "piece int, level int, low long, step long")), "piece")
    key = F.when(F.col("level") == 0, F.col("h"))
    for level, c in enumerate(_LEVELS[1:], 1):
        key = key.when(F.col("level") == level, F.col(c))
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.expr("cast((x - low) div step as int)")))
    placed = placed.withColumn("x", key).withColumn("part", part).withColumn("shard", F.floor(F.col("piece") / per).cast("int")).drop("x", "level", "low", "step")

    counted = work.write(placed.groupBy("shard", "piece", "part").agg(F.count("*").alias("n")), "counts")  # at most pieces * parts rows
    before = Window.partitionBy("shard").orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = work.write(counted.select("piece", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    order = Window.partitionBy("piece", "part").orderBy(*_LEVELS)
    ranked = placed.withColumn("rank", F.row_number().over(order)).join(first, ["piece", "part"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), *(F.col(f"p_{c}").alias(c) for c in payload))


def _divisions(splitters: list[tuple], pieces: int, parts: int) -> list[tuple[int, int, int, int]]:
    """For each piece the level in which its keys are divided, where that begins, and how much of it a part takes."""
    out = []
    for p in range(pieces):
        low = splitters[p - 1] if 0 < p <= len(splitters) else _LOWEST
        high = splitters[p] if p < len(splitters) else (1 << _HASH_BITS, 1 << 40, 1 << 32, 1 << 62)
        level = next((k for k in range(len(_LEVELS)) if low[k] < high[k]), 0)
        out.append((p, level, low[level], max(1, -(-(high[level] - low[level]) // parts))))
    return out


def op5(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts are empty ones; repeated rows have a slot each; further columns, whatever their
    names, are ignored; no rows give none.
    """
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
