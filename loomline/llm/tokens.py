"""Words of many texts at once: positions and 64-bit hashes, found in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = int(_rng.integers(0, 1 << 64, dtype=np.uint64)) | 5
_weights = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting, which for millions of numbers is far quicker than a hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _powers(count: int) -> np.ndarray:
    global _weights
    if len(_weights) < count:
        factors = np.full(max(count, 2 * len(_weights)), _STEP, np.uint64)
        factors[0] = 1
        _weights = np.multiply.accumulate(factors)
    return _weights[:count]


def slices(texts: list[bytes], size: int) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` bytes together."""
    limits = np.cumsum([len(t) for t in texts]) // size
    edges = [0, *(np.flatnonzero(np.diff(limits)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and the number of words of each text.

    The texts go in slices, as the arrays of a slice take some 40 bytes a byte of text.
    """
    found = [_word_hashes(texts[a:b]) for a, b in slices(texts, SLICE_BYTES)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    word = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    # Position within its word, for the bytes of words alone.
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = _BYTE[_LOWER[data[word]]] * _powers(int(sizes.max()))[within]
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return mixed(sums + sizes.astype(np.uint64)), counts
