"""Words, word hashes and shingle sets on whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import TASK_MEMORIES

#: Bound on the remembered word hashes of a worker.
CACHE_WORDS = 250_000

_HASHES: dict[bytes, int] = {}
TASK_MEMORIES.append(_HASHES)
_A = np.uint64(0x9E3779B97F4A7C15)


def fold_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = _HASHES
    try:
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(known) > CACHE_WORDS:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none give none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    m = min(n, k)
    s = np.full(n - m + 1, m, dtype=np.uint64)
    for i in range(m):
        s = s * _A + h[i : n - m + 1 + i]
    return np.unique(scramble(s))
