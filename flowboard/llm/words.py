"""Words of a text as hashes, and shingles of words. Runs inside Python workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of one shingle.
SHINGLE = 5
#: Words remembered per worker.
CACHE_WORDS = 300_000
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> bytes:
        h = xxhash.xxh3_64_digest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _Words()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (letters, digits, underscores) of the lower-cased text, in order."""
    return np.frombuffer(b"".join(map(_words.__getitem__, _WORD.findall(text.lower()))), dtype="<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others (the splitmix64 finaliser)."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words, in order and with repeats; of all words together if they are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mix(out * _ODD + words[i:n - k + 1 + i])
    return out
