"""Word shingles as 64-bit hashes, the same in every process.

Words are runs of anything but a space, tab, line feed, vertical tab, form feed or carriage return, with A-Z
lower-cased. ``bytes.lower`` and ``bytes.split`` do just that to UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of every run of ``width`` words, in order; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _K
    for i in range(1, width):
        out ^= out >> _S
        out = (out + hashes[i : i + n]) * _K
    out ^= out >> _S
    out *= _M
    return out ^ (out >> _S)


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one shingle, no words none."""
    return np.unique(shingles(word_hashes(words), min(width, len(words)))) if words else np.zeros(0, np.uint64)
