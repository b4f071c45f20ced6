"""Hashes of words, kept by each worker, and of runs of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Words whose hashes a worker keeps before it starts anew; only speed depends on it.
KEPT_WORDS = 150_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class _WordHashes(dict):
    def __missing__(self, word: str | bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def word_hashes(words: Sequence[str | bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


def run_hashes(h: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(n, hashes)`` of all runs of n words, for each n of ``lengths`` in ascending order."""
    total, done = h, 1
    for n in sorted(lengths):
        while done < min(n, len(h)):
            total = total[:-1] * _BASE + h[done:]
            done += 1
        yield n, mixed(total) if n <= len(h) else h[:0]
