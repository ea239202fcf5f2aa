"""Word shingles as 64-bit hashes, and their minima, in numpy inside tasks."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from .common import Remembered


@functools.lru_cache(maxsize=1)
def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest, 150_000)  # a miss costs little


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


@functools.lru_cache(maxsize=8)
def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of ``width`` words, in place order; none if there are fewer."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, m in enumerate(multipliers(width, width)):
        out += words[i:i + n] * m
    return mixed(out)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingles of the text, A-Z lower-cased; a shorter text is one shingle
    of all its words, a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashed_words(words), min(width, len(words))))


def minima(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minwise values of a non-empty set."""
    by = multipliers(n, seed)
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096, None] * by
        part ^= part >> np.uint64(31)
        part *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(best, part.min(axis=0), out=best)
    return best
