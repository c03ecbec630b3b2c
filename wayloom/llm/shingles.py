"""Words and their hashes for operators on word n-grams, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches

#: Hashes of this many distinct words are kept by a worker.
CACHE_WORDS = 300_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
caches.register("shingles", _hashes.clear)


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text in UTF-8, with A-Z (and no other letter) in lower case if asked."""
    data = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashes(words: list[bytes]) -> np.ndarray:
    caches.claim("shingles")
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` consecutive words; none if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out = out * _M + h[j : j + n]
    return mix(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; all its words as one if they are fewer than size."""
    w = split(text, lower=True)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(windows(hashes(w), min(size, len(w))))
