"""Toxic spans by a linear-chain conditional random field, scored per document.

Only documents are labelled, so the labels of tokens are latent: in a document that is not
toxic all tokens are clean, in a toxic one at least one is not. The chain (states clean and
toxic) is fitted by the likelihood of the documents' labels under that constraint. All
sequences but the clean one are allowed in a toxic document, so its expected features follow
from forward-backward over all sequences less the share of the clean one.

Features of a token are the word and its beginnings, as far as they are far more frequent in
toxic documents, and, for tokens that have such a feature, the words beside it. In a document
nearly all tokens carry no feature; all of those have the same potential, so runs of them are
one power of a 2 x 2 matrix and forward-backward visits only the tokens that carry a feature.
A document's score is the probability that at least one of these tokens is toxic, if they
were independent given their marginals.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framespan.llm.quality_model import training_rows
from framespan.llm.storage import Workspace, all_of, unused
from framespan.llm.worker import ROWS, held, parts, release, trim

#: Bounds of what is learned from: documents of either label, word features, features of words
#: beside them, and token windows (all windows of a document, or none).
MAX_TRAINING_ROWS, MAX_FEATURES, MAX_CONTEXT_FEATURES, MAX_WINDOWS = 6_000, 4_000, 400, 12_000
#: A word feature is in so many toxic documents, and so many times likelier in one than in another: the fewer documents, the more.
SUPPORT = ((4, 40.0), (20, 12.0))
MIN_CONTEXT_WINDOWS = 20
#: A label with n documents weighs n to the power of one less this.
LABEL_POWER = 0.5
CUT, SPAN_CUT = 0.3, 0.5
#: Word beginnings of these lengths are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Tokens on either side of one with a word feature that are in its window, and the longest window (longer ones are cut in two or more).
WINDOW, LONGEST = 6, 64
_TOKEN = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 20
#: Features that a worker counts before it hands them on.
COUNTED = 50_000


def features_of(word: str) -> list[str]:
    """The word and its beginnings; ``word`` is in lower case."""
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def beside(words: list[str], k: int) -> list[str]:
    """Features of the words before and after the word ``k``."""
    return [f"<:{words[k - 1]}" if k else "<", f">:{words[k + 1]}" if k + 1 < len(words) else ">"]


@dataclass
class Chain:
    """Weights of features in the toxic state, its bias, and log transition potentials [from, to]."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray

    def emission(self, word: str) -> float | None:
        """Log potential of the toxic state against the clean one, but for the words beside it; None for a word without features."""
        own = [self.weights[f] for f in features_of(word) if f in self.weights]
        return self.bias + sum(own) if own else None

    def context(self, words: list[str], k: int) -> float:
        """What the words beside the word ``k`` add to its potential."""
        return sum(self.weights.get(f, 0.0) for f in beside(words, k))


def _powers(chain: Chain) -> np.ndarray:
    """Products of k steps over tokens without features, scaled, for k = 0 to 256; beyond that they no longer change."""
    step = np.exp(chain.transitions) * np.array([1.0, np.exp(chain.bias)])
    out = [np.eye(2)]
    for _ in range(256):
        m = out[-1] @ step
        out.append(m / m.max())
    return np.array(out)


def marginals(chain: Chain, powers: np.ndarray, at: list[int], emissions: list[float], length: int) -> np.ndarray:
    """Probability of the toxic state at the tokens ``at`` (with these emissions) of a text of ``length`` tokens."""
    step = np.exp(chain.transitions)
    n = len(at)
    own = [np.array([1.0, np.exp(min(e, 60.0))]) for e in emissions]
    forward = np.empty((n, 2))
    v = np.array([1.0, np.exp(chain.bias)]) @ powers[min(at[0] - 1, 256)] @ step if at[0] else np.ones(2)
    for k in range(n):
        if k:
            v = forward[k - 1] @ powers[min(at[k] - at[k - 1] - 1, 256)] @ step
        v = v * own[k]
        forward[k] = v / v.sum()
    backward = np.empty((n, 2))
    backward[-1] = powers[min(length - 1 - at[-1], 256)] @ np.ones(2)
    for k in range(n - 2, -1, -1):
        v = powers[min(at[k + 1] - at[k] - 1, 256)] @ step @ (own[k + 1] * backward[k + 1])
        backward[k] = v / v.sum()
    both = forward * backward
    return both[:, 1] / both.sum(1)


class _Emissions(dict):
    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain

    def __missing__(self, word: str) -> float | None:
        if len(self) > 100_000:
            self.clear()
        e = self.chain.emission(word)
        if len(word) <= 64:
            self[word] = e
        return e


class Tagger:
    def __init__(self, chain: Chain):
        self.chain, self.powers, self.known = chain, _powers(chain), _Emissions(chain)

    def _before(self, word: str | None) -> float:
        return self.chain.weights.get("<" if word is None else f"<:{word}", 0.0)

    def _after(self, word: str | None) -> float:
        return self.chain.weights.get(">" if word is None else f">:{word}", 0.0)

    def _pieces(self, text: str):
        at = 0
        while at < len(text):
            end = min(at + _PIECE, len(text))
            while end < len(text) and (text[end].isalpha() and text[end - 1].isalpha()):
                end += 1
            yield at, text[at:end]
            at = end

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score and the toxic spans (start, end, probability), by code points."""
        at, emissions, spans, length, last = [], [], [], 0, None
        for begin, piece in [(0, text)] if len(text) <= _PIECE else self._pieces(text):
            words = _TOKEN.findall(piece)
            found = [k for k, e in enumerate(map(self.known.__getitem__, map(str.lower, words))) if e is not None]
            if last is not None and words:  # the last word of the piece before is followed by the first of this one
                emissions[last] += self._after(words[0].lower())
                last = None
            if found:
                wanted = set(found)
                for k, m in enumerate(_TOKEN.finditer(piece)):
                    if k in wanted:
                        spans.append((begin + m.start(), begin + m.end()))
                at += [length + k for k in found]
                for k in found:
                    low = words[k].lower()
                    before = words[k - 1].lower() if k else previous if length else None
                    more = self._before(before)
                    if k + 1 < len(words):
                        more += self._after(words[k + 1].lower())
                    else:
                        last = len(emissions)
                    emissions.append(self.known[low] + more)
            if words:
                previous = words[-1].lower()
            length += len(words)
        if last is not None:
            emissions[last] += self._after(None)
        if not at:
            return 0.0, []
        p = marginals(self.chain, self.powers, at, emissions, length)
        merged: list[tuple[int, int, float]] = []
        before = -2
        for k, (start, end), q in zip(at, spans, p.tolist()):
            if q >= SPAN_CUT:
                if merged and k == before + 1:
                    merged[-1] = (merged[-1][0], end, max(merged[-1][2], q))
                else:
                    merged.append((start, end, q))
                before = k
        return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), merged


def _expectations(own: np.ndarray, jump: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains (n, width): marginals of the toxic state, expected transitions (n, 2, 2), and the log probability of the clean sequence.

    ``own`` has potentials (n, width, 2), that of the clean state 1; ``there`` says which places a chain has, from the first on.
    """
    n, width = there.shape
    forward, backward, scale = np.zeros((n, width, 2)), np.ones((n, width, 2)), np.zeros((n, width))
    v = own[:, 0]
    for t in range(width):
        if t:
            v = (forward[:, t - 1] @ jump) * own[:, t]
        total = v.sum(1)
        scale[:, t] = np.where(there[:, t], np.log(total), 0.0)
        forward[:, t] = np.where(there[:, t, None], v / total[:, None], forward[:, t - 1] if t else v)
    for t in range(width - 2, -1, -1):
        v = (own[:, t + 1] * backward[:, t + 1]) @ jump.T
        backward[:, t] = np.where(there[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
    p = forward * backward
    p = np.where(there[..., None], p / p.sum(-1, keepdims=True), 0)
    pair = forward[:, :-1, :, None] * jump * (own[:, 1:] * backward[:, 1:])[:, :, None, :]
    total = np.where(there[:, 1:], pair.sum((-1, -2)), 1.0)
    pair = np.where(there[:, 1:, None, None], pair / total[..., None, None], 0)
    clean = np.log(jump[0, 0]) * (there.sum(1) - 1) - scale.sum(1)
    return p[..., 1], pair.sum(1), clean


class _Group:
    """Windows of about one length, as arrays: their documents, which places they have, and where which feature is."""

    def __init__(self, windows: list[tuple[int, list[str]]], index: dict[str, int]):
        self.owner = np.array([d for d, _ in windows])
        lengths = np.array([len(w) for _, w in windows])
        self.there = np.arange(lengths.max())[None, :] < lengths[:, None]
        row, column, feature = [], [], []
        for i, (_, words) in enumerate(windows):
            for t, w in enumerate(words):
                found = [index[f] for f in features_of(w) if f in index]
                if found:
                    found += [index[f] for f in beside(words, t) if f in index]
                row += [i] * len(found)
                column += [t] * len(found)
                feature += found
        self.row, self.column, self.feature = np.array(row, int), np.array(column, int), np.array(feature, int)

    def expectations(self, weights: np.ndarray, bias: float, jump: np.ndarray):
        score = np.full(self.there.shape, bias)
        np.add.at(score, (self.row, self.column), weights[self.feature])
        return _expectations(np.stack([np.ones(score.shape), np.exp(np.clip(score, -30, 30))], -1), jump, self.there)


def fit(documents: list[tuple[list[list[str]], int]], features: list[str], context: list[str] = (), steps: int = 120, l2: float = 3e-4, rate: float = 0.3) -> Chain:
    """Fit a chain to documents, given as windows of words and a label 0 or 1, by gradient steps on the mean log likelihood of the labels.

    Windows are chains of their own; a toxic document has a toxic token in at least one of
    them.
    """
    documents = [d for d in documents if d[0]]
    if not documents or not features:
        return Chain({}, -10.0, np.zeros((2, 2)))
    label = np.array([y for _, y in documents], float)
    index = {f: k for k, f in enumerate([*features, *context])}
    many = len(index)
    by_width: dict[int, list[tuple[int, list[str]]]] = {}
    for d, (own, _) in enumerate(documents):
        for words in own:
            by_width.setdefault(-(-len(words) // 8), []).append((d, words))
    groups = [_Group(w, index) for _, w in sorted(by_width.items())]
    weight = np.where(label == 1, max(label.sum(), 1.0) ** -LABEL_POWER, max((1 - label).sum(), 1.0) ** -LABEL_POWER)
    weight /= weight.sum()
    # The jump from clean to clean has the potential 1, as that of the clean state.
    params = np.zeros(many + 4)
    params[: len(features)], params[many] = 1.0, -3.0
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        jump = np.exp(np.array([0.0, *params[many + 1 :]]).reshape(2, 2))
        found = [g.expectations(params[:many], params[many], jump) for g in groups]
        clean = sum(np.bincount(g.owner, c, len(documents)) for g, (_, _, c) in zip(groups, found))
        all_clean = np.exp(np.minimum(clean, -1e-9))
        # Expected features given the label, less those without it: clean documents lose all, toxic ones gain what the clean sequence took.
        share = weight * np.where(label == 1, np.minimum(all_clean / (1 - all_clean), 1e6), -1.0)
        gradient = -l2 * params
        gradient[many] = 0
        for g, (toxic, jumps, _) in zip(groups, found):
            off = toxic * share[g.owner, None]
            gradient[:many] += np.bincount(g.feature, off[g.row, g.column], many)
            gradient[many] += off.sum()
            gradient[many + 1 :] += np.einsum("n,nab->ab", share[g.owner], jumps).ravel()[1:]
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        params = params + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Chain({f: float(params[k]) for f, k in index.items()}, float(params[many]), np.array([0.0, *params[many + 1 :]]).reshape(2, 2))


def _counts(batches):
    """Features with the numbers of documents, and of toxic ones, that have them; memory is bounded by ``COUNTED`` features and one document."""
    release()
    toxic, n = Counter(), Counter()

    def rows():
        found = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([toxic[f] for f in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["f", "toxic", "n"])
        toxic.clear()
        n.clear()
        return found

    for batch in batches:
        labels = iter(batch.column("label").to_pylist())
        for t in (t for part in parts(batch.column("text")) for t in part):
            words = {m.group() for m in _TOKEN.finditer((t or "").lower())}
            own = {f for w in words for f in features_of(w)}
            n.update(own)
            if next(labels):
                toxic.update(own)
            if len(n) > COUNTED:
                yield rows()
    yield rows()
    trim()


def windows_of(words: list[str], chosen: frozenset[str]) -> list[list[str]]:
    """All windows of a document: the tokens around those that carry a feature in ``chosen``; overlapping ones are one, long ones are cut."""
    marked = [k for k, w in enumerate(words) if any(f in chosen for f in features_of(w))]
    spans: list[list[int]] = []
    for k in marked:
        low, high = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    return [words[at : min(at + LONGEST, high)] for low, high in spans for at in range(low, high, LONGEST)]


def _windows(chosen: frozenset[str]):
    """Per document its windows; a clean document without any gives the middle of its text, so that featureless tokens are learned, a toxic one nothing."""

    def cut(batches):
        release()
        for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            out, labels = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = _TOKEN.findall((text or "").lower())
                own = windows_of(words, chosen)
                if not own and words and not label:
                    own = [words[max(0, len(words) // 2 - WINDOW) : len(words) // 2 + WINDOW + 1]]
                if own:
                    out.append(own)
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.string()))), pa.array(labels, pa.int32()), pa.array(map(len, out), pa.int64())], names=["windows", "label", "n"])
        trim()

    return cut


def context_of(documents: list[tuple[list[list[str]], int]], chosen: frozenset[str]) -> list[str]:
    """The most frequent features of words beside tokens with a feature in ``chosen``, by the windows they are in."""
    seen = Counter(f for own, _ in documents for words in own for f in {f for k, w in enumerate(words) if any(g in chosen for g in features_of(w)) for f in beside(words, k)})
    return sorted(f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_CONTEXT_FEATURES] if n >= MIN_CONTEXT_WINDOWS)


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit on labelled documents that are not held out, at most ``MAX_TRAINING_ROWS`` of either label."""
    work = Workspace(docs.sparkSession, "toxicity")
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    both = [training_rows(docs, labels.where(F.col("toxic") == k), "toxic", allowed, MAX_TRAINING_ROWS) for k in (0, 1)]
    sample = work.write(both[0].union(both[1]).select("doc_id", "text", "label").dropDuplicates(["doc_id", "label"]), "sample")
    numbers = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not numbers.get(0) or not numbers.get(1):
        return fit([], [])
    counted = sample.select("text", "label").mapInArrow(_counts, "f string, toxic long, n long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    odds = (F.col("toxic") / numbers[1]) / ((F.col("n") - F.col("toxic") + 0.5) / numbers[0])
    supported = reduce(or_, ((F.col("toxic") >= n) & (odds >= ratio) for n, ratio in SUPPORT))
    chosen = counted.where(supported).orderBy(F.desc("toxic"), "f").limit(MAX_FEATURES)
    features = sorted(r["f"] for r in chosen.select("f").collect())
    own = frozenset(features)
    cut = work.write(sample.select("text", "label").mapInArrow(_windows(own), "windows array<array<string>>, label int, n long"), "windows")
    before = F.sum("n").over(Window.orderBy(F.xxhash64("windows", "label"), "label").rowsBetween(Window.unboundedPreceding, -1))
    taken = cut.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("n") <= MAX_WINDOWS)  # of at most 2 * MAX_TRAINING_ROWS rows
    documents = [(r["windows"], r["label"]) for r in taken.select("windows", "label").collect()]
    work.drop(sample, cut)
    return fit(documents, features, context_of(documents, own))


def tagger(chain: Chain):
    """A column function: text to struct(score, spans array of struct(start, end, p))."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(span))])
    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))])

    @F.arrow_udf(out)
    def tag(text: pa.Array) -> pa.Array:
        own = _tagger_of(chain)
        found = [own.tag(t or "") for part in parts(text) for t in part]
        return pa.array([{"score": s, "spans": [{"start": a, "end": b, "p": p} for a, b, p in spans]} for s, spans in found], kind)

    return tag


def _tagger_of(chain: Chain) -> Tagger:
    """The tagger of a chain; a worker keeps it between batches."""
    return held(("tagger", chain.bias, len(chain.weights), chain.transitions.tobytes()), lambda: Tagger(chain))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    Null and empty texts score 0, repeated rows score alike; without labels of both kinds
    all score 0. held_out of a null doc_id is null. Further columns, whatever their names,
    are ignored; no rows give none.
    """
    tag = tagger(train(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    tagged = docs.select("doc_id", held_out.alias("held_out"), tag(F.col("text").cast("string")).alias("t"))
    return tagged.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= CUT).cast("int").alias("predicted"), F.col("t.spans").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns, whatever their names, as they are."""
    tag, (name,) = tagger(train(docs, labels)), unused(docs.columns, "tag")
    tagged = docs.withColumn(name, tag(F.col("text").cast("string"))).where(F.col(name)["score"] < CUT)
    return tagged.select(*all_of(tagged, docs.columns))
