import itertools
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framespan.llm import toxicity, worker
from framespan.llm.toxicity import Chain, Tagger, _expectations, _powers, features_of, fit, keep_clean, marginals, op8, windows_of


def by_sum(chain, emissions):
    """Marginals of the toxic state by going through all state sequences."""
    total, toxic = 0.0, np.zeros(len(emissions))
    for states in itertools.product((0, 1), repeat=len(emissions)):
        score = sum(e for s, e in zip(states, emissions) if s) + sum(chain.transitions[a, b] for a, b in zip(states, states[1:]))
        total += np.exp(score)
        toxic += np.exp(score) * np.array(states)
    return toxic / total


@pytest.mark.parametrize("seed", range(20))
def test_marginals_equal_the_sum_over_sequences(seed):
    rng = np.random.default_rng(seed)
    chain = Chain({}, -1.5, rng.normal(size=(2, 2)))
    n = int(rng.integers(1, 10))
    at = sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
    own = rng.normal(1, 2, len(at)).tolist()
    emissions = [chain.bias] * n
    for k, e in zip(at, own):
        emissions[k] = e
    assert np.allclose(marginals(chain, _powers(chain), at, own, n), by_sum(chain, emissions)[at])


def test_expectations_equal_the_sum_over_sequences():
    rng = np.random.default_rng(3)
    jump, lengths = np.exp(rng.normal(size=(2, 2))), [1, 4, 6]
    own = np.stack([np.ones((3, 6)), np.exp(rng.normal(size=(3, 6)))], -1)
    there = np.arange(6)[None, :] < np.array(lengths)[:, None]
    toxic, jumps, clean = _expectations(own, jump, there)
    for i, n in enumerate(lengths):
        total, one, two, none = 0.0, np.zeros(n), np.zeros((2, 2)), 0.0
        for s in itertools.product((0, 1), repeat=n):
            w = np.prod([own[i, t, s[t]] for t in range(n)]) * np.prod([jump[a, b] for a, b in zip(s, s[1:])])
            total, one, none = total + w, one + w * np.array(s), none + w * (not any(s))
            for a, b in zip(s, s[1:]):
                two[a, b] += w
        assert np.allclose(toxic[i, :n], one / total) and np.allclose(jumps[i], two / total) and np.isclose(clean[i], np.log(none / total))


def test_fit_and_spans():
    documents = [([["the", "vilest", "man", "came"]], 1), ([["the", "kind", "man", "came"], ["a", "kind", "word"]], 0)] * 20
    tagger = Tagger(fit(documents, ["5:viles"]))
    score, spans = tagger.tag("Oh, VILEST — and vileship, 😀 he said. " + "a b c " * 200_000 + "vilest")
    assert score > 0.9 and [(a, b) for a, b, _ in spans] == [(4, 10), (17, 25), (1_200_038, 1_200_044)]
    assert tagger.tag("") == (0.0, []) and tagger.tag("a kind man")[0] == 0


def test_words_beside_a_token():
    """What is before and after a word decides, also where a piece of a long text ends beside it."""
    documents = [([["you", "rotten", "one"]], 1), ([["a", "rotten", "apple"]], 0)] * 30
    tagger = Tagger(fit(documents, ["w:rotten"], ["<:a", "<:you", ">:apple", ">:one"], l2=1e-5))
    assert tagger.tag("You rotten one")[0] > 0.9 and tagger.tag("a rotten apple")[0] < 0.3
    filler = "x " * ((1 << 19) - 4)
    for shift in range(12):
        text = " " * shift + filler
        assert abs(tagger.tag(text + "you rotten one and more")[0] - tagger.tag("x you rotten one and more")[0]) < 0.05
        assert tagger.tag(text + "a rotten apple and more")[0] < 0.3


def test_all_windows_and_whole_words_are_learned_from():
    words = ["x"] * 400
    for k in (3, 100, 250, 399):
        words[k] = "vile" + "y" * 100
    assert features_of(words[3])[0] == "w:vile" + "y" * 100
    own = windows_of(words, frozenset([features_of(words[3])[0]]))
    assert [len(w) for w in own] == [10, 13, 13, 7] and sum(w.count(words[3]) for w in own) == 4
    assert sum(map(len, windows_of([words[3]] * 300, frozenset(["4:vile"])))) == 300


def test_features_of_many_documents_are_counted_in_little_memory():
    """A worker that held another operator's cache lets it go, and counts without all documents' features at once."""
    texts = [" ".join(f"word{chr(97 + k % 26)}{'abcdefghij'[d % 10]}{chr(97 + k // 26)}" for k in range(200)) for d in range(4000)] + [None, "", "Vile vile VILE"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([d % 2 for d in range(len(texts))], pa.int32())], names=["text", "label"])
    wanted, toxic = Counter(), Counter()
    for d, t in enumerate(texts):
        own = {f for w in toxicity._TOKEN.findall((t or "").lower()) for f in features_of(w)}
        wanted.update(own)
        toxic.update(own if d % 2 else ())
    worker.held("another operator's", lambda: bytearray(1 << 20))
    tracemalloc.start()
    found = list(toxicity._counts(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not worker._held and peak < 20 << 20  # as lists of each document's features they took 80 MB
    n, t = Counter(), Counter()
    for r in (r for b in found for r in b.to_pylist()):
        n[r["f"]] += r["n"]
        t[r["f"]] += r["toxic"]
    assert n == wanted and +t == toxic


def test_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["vile words", "other words", "vile others here"]), pa.array([1, 0, 1], pa.int32())], names=["text", "label"])
    found = list(toxicity._counts(iter([batch, batch])))
    assert len(found) > 2 and sum(r["n"] for b in found for r in b.to_pylist() if r["f"] == "w:vile") == 4
    assert [b.num_rows for b in toxicity._counts(iter([]))] == [0]


def test_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    right = {0: [], 1: []}
    for r in op8(docs, labels).select("doc_id", "held_out", "score", "predicted").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in toxic:
            right[toxic[r["doc_id"]]].append(r["predicted"] == toxic[r["doc_id"]])
    print({k: (len(v), float(np.mean(v))) for k, v in right.items()})
    assert min(map(len, right.values())) > 50 and np.mean(right[0]) > 0.97 and np.mean(right[1]) > 0.9


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some vile text here", "y"), (3, "some vile text here", "y"), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, 1, None), (None, 1, 1), (4, None, 0)], none.schema)
    for labels in (none, some):
        assert op8(docs, labels).count() == 5 and op8(docs.limit(0), labels).count() == 0
        kept = keep_clean(docs, labels)
        assert kept.columns == docs.columns and kept.count() == 5
