"""Vectorised 64-bit hashes of word windows, for scans that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: An odd multiplier for polynomial hashes modulo 2**64 (the golden ratio's fraction).
BASE = 0x9E3779B97F4A7C15
CACHE_WORDS = 500_000


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the words of few texts are in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHasher:
    """Maps words to 64-bit hashes; its cache only saves time and is emptied when it is full."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for word in set(words).difference(cache):
            cache[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of ``n`` words; empty when there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    base = np.uint64(BASE)
    for k in range(n):
        out = out * base + hashes[k : k + count]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def concatenated(lists: Iterable[list[str]]) -> tuple[list[str], np.ndarray]:
    """All words of a batch in one list and the offset of each record in it."""
    words: list[str] = []
    offsets = [0]
    for part in lists:
        words += part
        offsets.append(len(words))
    return words, np.asarray(offsets, np.int64)
