"""Hashes of words and of runs of words, shared by the operators that compare shingles.

Defined results: words are cut at ASCII white space alone; a null text has none; a run of k words has one 64-bit hash, which depends on their order and on k.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42
CACHED_WORDS = 200_000

_ORDER = np.random.default_rng(SEED).integers(0, 1 << 63, 16, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts at a time are Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k words that follow each other, from the hashes of words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _ORDER[0]
    for i in range(1, k):
        total = mixed(total) + h[i : n + i] * _ORDER[i % 16]
    return mixed(total + np.uint64(k))
