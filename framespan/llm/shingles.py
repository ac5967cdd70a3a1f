"""Word shingles of texts as 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

import re

import numpy as np

_U = np.uint64
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
for _upper in range(0x41, 0x5B):  # A-Z count as a-z
    _TABLE[_upper] = _TABLE[_upper + 32]
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 2 * _PIECE)
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        _POWERS = np.cumprod(step)
        step = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = 1
        _INVERSES = np.cumprod(step)


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(word)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    _grow(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * _POWERS[: len(raw)], out=total[1:])
    return mix((total[last] - total[first]) * _INVERSES[first] + (last - first).astype(np.uint64)), first


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z as a-z) and the bytes where they begin; memory follows the piece, not the text."""
    if len(data) <= 2 * _PIECE:
        return _piece_words(data)
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.end() if found else len(data)
        h, b = _piece_words(data[at:end])
        hashes.append(h)
        begins.append(b + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def shingle_batch(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of all texts, text after text, and how many each text has.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    data = b"\n".join(texts) + b"\n"
    words, begins = word_hashes(data)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begins, edges)
    count = np.diff(first)
    number = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    total = int(number.sum())
    if not total:
        return np.zeros(0, np.uint64), number
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | _U(1)
    at = np.repeat(first[:-1], number) + np.arange(total) - np.repeat(np.cumsum(number) - number, number)
    joined = padded[at] * factors[0]
    for k in range(1, width):
        joined += padded[at + k] * factors[k]
    out_first = np.cumsum(number) - number
    for d in np.flatnonzero((count > 0) & (count < width)):
        n = int(count[d])
        own = words[first[d] : first[d] + n]
        joined[out_first[d]] = (own * factors[:n]).sum(dtype=np.uint64) + factors[n] * _U(n)
    return mix(joined), number


def groups(texts: list[bytes], most: int = _PIECE):
    """Ranges of ``texts`` of about ``most`` bytes each."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
