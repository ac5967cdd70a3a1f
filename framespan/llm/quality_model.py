"""Document quality by gradient-boosted trees over statistics of the text."""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.boosting import Trees, fit
from framespan.llm.storage import all_of, unused
from framespan.llm.worker import parts, release

#: Labelled documents that the trees are fitted on, at most.
MAX_TRAINING_ROWS = 20_000
#: A document is predicted to be good from this score on.
CUT = 0.5
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_GROUPS = [np.frombuffer(g, np.uint8) for g in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\v\f\r", b"\n", b"!", b"|", b"#*$%&<>", b".", b",", b"?:;", b"'\"()-")]
FEATURES = ["log_bytes", *(f"group_{k}" for k in range(len(_GROUPS))), "beyond_ascii", "entropy", "log_words", "word_bytes", "distinct_words", "same_as_before", "line_words", "repeated_lines", "longest_word"]


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end


class _Lines:
    """Numbers of lines that are not empty, and of those equal to an earlier one, of a text that comes in pieces."""

    def __init__(self):
        self.n = self.repeated = 0
        self._seen: set[bytes] = set()
        self._open, self._size = xxhash.xxh3_128(), 0

    def _end(self) -> None:
        if self._size:
            key = self._open.digest()
            self.n, self.repeated = self.n + 1, self.repeated + (key in self._seen)
            self._seen.add(key)
            self._open, self._size = xxhash.xxh3_128(), 0

    def add(self, piece: bytes) -> None:
        first, *others = piece.split(b"\n")
        self._open.update(first)
        self._size += len(first)
        for line in others:
            self._end()
            self._open.update(line)
            self._size = len(line)

    def ends(self) -> tuple[int, int]:
        self._end()
        return self.n, self.repeated


def statistics(text: bytes) -> list[float]:
    """The ``FEATURES`` of a whole text. An empty text has zeros.

    A text over 1 MB is gone through in pieces that end at white space; what spans pieces
    (distinct words, the word before, lines) is carried on, so the numbers are those of the whole.
    """
    if not text:
        return [0.0] * len(FEATURES)
    if len(text) <= _PIECE:
        bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x]
        n_words, distinct, n_same, longest = len(words), len(set(words)), sum(map(eq, words, words[1:])), max(map(len, words), default=0)
        n_lines, repeated = len(lines), len(lines) - len(set(lines))
    else:
        bytes_of, seen, before, rows = np.zeros(256, np.int64), set(), None, _Lines()
        n_words = n_same = longest = 0
        for piece in _pieces(text):
            bytes_of += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
            rows.add(piece)
            words = piece.split()
            if words:
                n_words += len(words)
                n_same += sum(map(eq, words, words[1:])) + (words[0] == before)
                longest = max(longest, max(map(len, words)))
                before = words[-1]
                seen.update(words)
        distinct, (n_lines, repeated) = len(seen), rows.ends()
    n, w = len(text), max(n_words, 1)
    shares = bytes_of[bytes_of > 0] / n
    return [
        float(np.log1p(n)), *(float(bytes_of[g].sum()) / n for g in _GROUPS), float(bytes_of[128:].sum()) / n,
        float(-(shares * np.log2(shares)).sum()), float(np.log1p(n_words)), n / w, distinct / w, n_same / w, w / max(n_lines, 1), repeated / max(n_lines, 1), float(longest),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pa.Array) -> pa.Array:
    return pa.array([statistics(t or b"") for part in parts(text.cast(pa.binary())) for t in part], pa.list_(pa.float64()))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, allowed, most: int) -> DataFrame:
    """Up to ``most`` rows (doc_id, text, label) of documents labelled in ``column``, by order of a hash."""
    named = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & allowed).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).distinct()
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Fit on at most ``MAX_TRAINING_ROWS`` labelled documents, none of them held out."""
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    rows = training_rows(docs, labels, "quality", allowed, MAX_TRAINING_ROWS).select("doc_id", "label", _statistics("text").alias("x"))
    found = rows.orderBy(F.xxhash64("doc_id", "x"), "label").limit(MAX_TRAINING_ROWS).select("label", "x").collect()
    x = np.array([r["x"] for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], np.float64))


def scorer(model: Trees):
    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        release()
        x = np.array([statistics(t or b"") for part in parts(text.cast(pa.binary())) for t in part], np.float64).reshape(-1, len(FEATURES))
        return pa.array(model.probability(x))

    return score


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones, repeated rows alike; without labels of both kinds
    every score is the same. held_out of a null doc_id is null. Further columns, whatever
    their names, are ignored; no rows give none.
    """
    score = scorer(train(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all columns, whatever their names, as they are."""
    score, (name,) = scorer(train(docs, labels)), unused(docs.columns, "score")
    scored = docs.withColumn(name, score(F.col("text").cast("string"))).where(F.col(name) >= CUT)
    return scored.select(*all_of(scored, docs.columns))
