import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framespan.llm.packing import WordIds, best_fit_runs, op1

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: how full the bins are."""
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rest) if r >= n]
        if fits:
            rest[min(fits, key=lambda k: rest[k])] -= n
        else:
            rest.append(capacity - n)
    return sorted(rest)


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 20, 150]))]
    fill, ranks = defaultdict(list), Counter()
    for length, low, high, first, each, offset in best_fit_runs(Counter(lengths), capacity):
        assert ranks[length] == low
        ranks[length] = high
        for k in range(high - low):
            fill[first + k // each].append((offset + k % each * length, length))
    assert ranks == Counter(lengths)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in fill.values()) == one_by_one(lengths, capacity)


def test_ids_equal_the_tokenizers():
    lookup, plain = WordIds(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "é", "ß", "İ", "Σ", "7", ".", ",", "!", "'s", "'", " ", "\n", "\t", "\x0b", " ", "\x1c", "　", "日", "<|endoftext|>", "#", "re", "😀", "-", ".,", "!!", "*", "ς", "Э", "ॐ", "क़", "ﬁ", "ª"]
    for _ in range(20000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(lookup.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    text = "Word after word, again. " * 100_000
    assert np.frombuffer(lookup.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(900001, None, "x"), (900002, "", "x"), (900003, "word " * 5000, "x"), (900003, "word " * 5000, "x"), (None, "a b", None)], docs.schema)
    texts = defaultdict(list)
    for r in docs.union(extra).collect():
        texts[r["doc_id"]].append(r["text"] or "")
    plain, got = Tokenizer.from_file(PATH), op1(docs.union(extra)).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = defaultdict(list)
    for d, many in texts.items():
        for t in many:
            ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want[d] += [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in pieces.items()}
    assert op1(docs.limit(0)).count() == 0
