"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

Words are maximal runs of characters other than space and U+0009-U+000D, after
A-Z are lower-cased.  Each word is hashed over its UTF-8 bytes and each shingle
over its word hashes, so a text is never cut into Python strings.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANES = [np.uint64(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of hashes, and of its inverse."""
    if _POWERS["n"] < n:
        n = max(n, 2 * _POWERS["n"], 1 << 16)
        up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The 64-bit hash of every word of one UTF-8 text given as uint8."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    terms[~inside] = 0
    return mix(np.add.reduceat(terms, starts) * down[starts] + (ends - starts).astype(np.uint64) * _LANES[4])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of a text given by its word hashes, in its order; with fewer words than width, the whole sequence as one; without words, none."""
    if not len(words):
        return words
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * _LANES[j % len(_LANES)]
    return mix(total)


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words than width, the whole sequence as one; without words, none."""
    return np.unique(shingles(word_hashes(data), width))
