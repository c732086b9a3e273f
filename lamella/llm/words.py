"""Hashes of words and word sequences, in numpy."""

from __future__ import annotations

import numpy as np

from lamella.llm.common import Memo, kept

FACTOR = 0x9E3779B97F4A7C15


def memo() -> Memo:
    """One memo of word hashes per worker process."""
    import xxhash

    return kept("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo().__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= np.uint64(FACTOR)
        out += hashes[j : j + count]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    count = len(x) - width + 1
    if count <= 0:
        return np.zeros(0, x.dtype)
    out = x[:count].copy()
    for j in range(1, width):
        np.minimum(out, x[j : j + count], out=out)
    return out


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's bigint."""
    return x - (1 << 64) if x >= 1 << 63 else x
