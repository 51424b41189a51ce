"""Whole texts as numpy arrays: code points, words and 64-bit hashes.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def release() -> None:
    """Give memory that Python and Arrow no longer use back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which nearby values become unrelated (splitmix64)."""
    x = x + _A
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words."""
    inside = np.empty(points.size + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = (points != 32) & ((points < 9) | (points > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of mixed (character, place in the word), mixed with the length."""
    if not starts.size:
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    chars = points[place + np.repeat(starts, lengths)].astype(np.uint64)
    mixed = mix((chars << np.uint64(32)) + place.astype(np.uint64))
    return mix(np.add.reduceat(mixed, first) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, rolled up from the word hashes."""
    if words.size < n:
        return np.empty(0, np.uint64)
    out = np.zeros(words.size - n + 1, np.uint64)
    for i in range(n):
        out = out * _B + words[i : words.size - n + 1 + i]
    return out
