"""Packing documents into token sequences by best-fit decreasing.

Lengths are whole numbers up to the capacity, so best-fit decreasing needs only how many
pieces there are of each length: at most ``capacity`` numbers, whatever the input's size.
The driver packs those counts with a segment tree over remaining capacities, which finds the
tightest open bin in logarithmic time, and places equal lengths into equal bins in one step;
the bins are those of packing the pieces one by one. What it decides is a table of runs (length, range of ranks, first bin), and each piece finds its place there
by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespan.llm.storage import BROADCAST_BYTES, Workspace
from framespan.llm.worker import held, parts, release

CAPACITY = 2048
#: Distinct words whose ids a worker remembers; beyond it, it begins anew.
REMEMBERED = 350_000
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Marks that the tokenizer never joins with the letters before them.
_ENDINGS = b".,;:!?*$#%&|\"()"
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds(dict):
    """Ids of a word without ASCII white space, as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words. Letters and closing marks are separate to it too, and ASCII case is not
    seen, so such words share what is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model

    def _encode(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word of letters only, straight from the merges; None if it is another word, or a rare script."""
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
        low = text.lower()
        if not low.isalpha() or max(low) >= "\u2000" or "\u03a3" in text:
            return None
        spelled = low.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return np.array([t.id for t in self._model.tokenize(spelled)], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        base = word.rstrip(_ENDINGS)
        if base and base != word:
            alone = self[base] if base.isalpha() else self._letters(base)
            ids = self._encode(word.decode("utf-8", "replace")) if alone is None else alone + self[word[len(base) :]]
        elif word.isalpha() and word != (low := word.lower()):
            ids = self[low]
        else:
            ids = self._letters(word)
            if ids is None:
                ids = self._encode(word.decode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if len(text) <= 2 * _PIECE:
            return b"".join(map(self.__getitem__, text.split()))
        parts, at = [], 0
        while at < len(text):
            end = min(at + _PIECE, len(text))
            if end < len(text):
                found = _SPACE.search(text, end)
                end = found.end() if found else len(text)
            parts.append(b"".join(map(self.__getitem__, text[at:end].split())))
            at = end
        return b"".join(parts)


def word_ids(path: str) -> WordIds:
    return held(("word ids", path), lambda: WordIds(path))


def _cutter(path: str, capacity: int, with_ids: bool):
    def cut(batches):
        lookup, part, seen = word_ids(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = defaultdict(list)
            texts = (t for part in parts(batch.column("text").cast(pa.binary())) for t in part)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = lookup.ids(text or b"") + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    n = len(own) // 4
                    for k, v in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(own)), ("part", part), ("local", seen[n])):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(own)
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=_schema(with_ids))

    return cut


def _schema(with_ids: bool) -> pa.Schema:
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())]
    return pa.schema(names + [("ids", pa.binary())] * with_ids)


class _Tree:
    """Which remaining capacities any open bin has; ``ceiling`` finds the least that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def put(self, value: int, there: bool) -> None:
        node = value + self.size
        self.any[node] = there
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def ceiling(self, value: int) -> int | None:
        node = value + self.size
        if self.any[node]:
            return value
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.any[2 * node])
                return node - self.size
            node //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces per bin, offset of the first) that pack ``counts``."""
    tree, open_bins, runs, bins = _Tree(capacity), defaultdict(list), [], 0

    def add(rest: int, first: int, n: int) -> None:
        if n and rest:
            open_bins[rest].append((first, n))
            tree.put(rest, True)

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        while left:
            rest = tree.ceiling(length)
            if rest is None:
                rest, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[rest].pop()
                if not open_bins[rest]:
                    tree.put(rest, False)
            each = rest // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - rest))
                add(rest - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                runs.append((length, rank, rank + left, first, left, capacity - rest))
                add(rest - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            add(rest, first, n)
    return runs


def _placer(runs: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches):
        release()  # words' ids are needed no more
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1] if len(keys) else table
            at = rank - run[:, 1]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(run[:, 3] + at // run[:, 4]), pa.array(run[:, 5] + at % run[:, 4] * length)], names=[*kept, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, and the sequence and offset where each is placed.

    A document's ids end with the id 0 (null and empty texts have only that); longer ones
    are cut every ``capacity`` ids. Returns doc_id, piece, start, length, ids_crc32, with
    ``with_ids`` also ids (little-endian 32-bit), then sequence_id and offset. Repeated rows
    are packed each on their own, further columns are ignored, no rows give none.
    """
    work = Workspace(docs.sparkSession, "packing")
    ids = ", ids binary" * with_ids
    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = work.write(cast.mapInArrow(_cutter(tokenizer_path, capacity, with_ids), f"doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long{ids}"), "pieces")
    counted = work.write(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = counted.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    # One row for each part, of at most ``capacity`` numbers.
    base = work.write(based.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases")), "bases")
    if base.count() * (16 * capacity + 64) <= BROADCAST_BYTES:
        base = F.broadcast(base)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(base, "part").select(*columns, (F.element_at("bases", F.col("length")) + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_placer(best_fit_runs(counts, capacity)), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")


def op1(docs: DataFrame) -> DataFrame:
    """The packing of ``documents`` into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
