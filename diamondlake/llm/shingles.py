"""Word shingles as sorted arrays of 64-bit hashes, computed over all bytes of a text at once."""

from __future__ import annotations

import functools

import numpy as np

_M = 0x9E3779B97F4A7C15
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: The same with all other ASCII characters that are neither letters nor digits.
PUNCTUATION = _SEPARATORS | np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODES = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=8)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2**64."""
    n = 1 << bits
    up, down = (np.full(n, f, np.uint64) for f in (_M, pow(_M, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_spans(raw: np.ndarray, separators: np.ndarray = _SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a run without blank, tab, line end, vertical tab or form feed."""
    gap = np.concatenate([[True], separators[raw], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_hashes(text: str, separators: np.ndarray = _SEPARATORS) -> np.ndarray:
    """A hash of each word, A-Z lower-cased, in order."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end = word_spans(raw, separators)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(10, len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[raw] * up[: len(raw)])])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words the whole sequence is one; without any, none."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(_M) + w[i : len(w) - size + 1 + i])
    return np.unique(out)
