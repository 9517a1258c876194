"""Word shingles of a text as 64-bit hashes, in a Python worker."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import holds_memory, lower_bytes

#: Most words in the memo of word hashes.
MEMO = 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
holds_memory("shingles", _WORDS.clear)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of values that are hashes already."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x165667B19E3779F9 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    words = lower_bytes(text).split()
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order."""
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(max(n, 0), k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ hashes[j : j + n]) * _M1
            h ^= h >> np.uint64(29)
            h *= _M2
    return h ^ (h >> np.uint64(32))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order, for long runs: a polynomial in an
    odd multiplier whose runs of twice the length come from two of the length."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, done, part, length, mult = np.zeros(n, dtype=np.uint64), 0, mixed(hashes, 50), 1, int(_M1)
        while True:
            if k & length:
                out = out * np.uint64(mult) + part[done : done + n]
                done += length
            if done == k:
                return mixed(out ^ (out >> np.uint64(31)), 51)
            part = part[:-length] * np.uint64(mult) + part[length:]
            length, mult = 2 * length, mult * mult % 2**64


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; a text with fewer
    words has its whole sequence as one, a text without words none."""
    words = [word_hashes(t) for t in texts]
    if not words:
        return []
    run = grams(np.concatenate(words), k)
    out, at = [], 0
    for w in words:
        n = len(w)
        if n >= k:
            s = run[at : at + n - k + 1]
            s = np.sort(s)
            if n > k:
                fresh = s[1:] != s[:-1]
                if not fresh.all():
                    s = s[np.concatenate([[True], fresh])]
        else:
            s = grams(w, n) if n else w
        out.append(s)
        at += n
    return out
