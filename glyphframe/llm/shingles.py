"""Word shingles of whole texts as 64-bit hashes, worked out for blocks of texts at once."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and multiplications) of x + seed * odd constant, wrapping."""
    x = x + np.uint64((seed * int(_ODD)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased, cut at ASCII white space), and the number of words of each."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    return hashes[np.concatenate(parts)] if len(ids) else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each, and where each text's begin and end.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    words, counts = words_of(texts)
    starts = np.cumsum(counts) - counts
    sets = []
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled * _ODD + words[k : len(words) - width + 1 + k]) if len(rolled) else rolled
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(rolled[start : start + n - width + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for k in range(n):
                whole = mix(whole * _ODD + words[start + k], seed=n)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets))))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds
