"""Words, lines and shingles of many texts at once, on their UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are
polynomials modulo 2**64 over random byte values, so the hash of any stretch is
a difference of two prefix sums; they go through a bijective mixer before use.
"""

from __future__ import annotations

import numpy as np

from tallystone.llm.common import mixed, process_cache

BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_values(seed: int) -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    cache = process_cache("powers")
    if len(cache.get(base, ())) < n:
        out = np.empty(n, np.uint64)
        out[0], k = 1, 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
            k += m
        if n <= 16 << 20:
            cache[base] = out
        return out
    return cache[base][:n]


def prefix(raw: np.ndarray, seed: int = 1) -> np.ndarray:
    """Prefix sums whose differences, scaled by ``scale``, are hashes of stretches."""
    out = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        np.cumsum(byte_values(seed)[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def stretches(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each stretch [lo, hi), equal for equal bytes wherever they stand."""
    inverse = powers(pow(BASE, -1, 2**64), len(sums))
    return mixed((sums[hi] - sums[lo]) * inverse[lo])


class Words:
    """Words of concatenated texts: ``begin``/``end`` bytes, ``hash``, and ``at``, each text's first word."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lower: bool = False):
        raw = _LOWER[raw] if lower else raw
        solid = ~_SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        before[edges] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.raw, self.offsets, self.solid = raw, offsets, solid
        self.begin = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.sums = prefix(raw)
        self.hash = stretches(self.sums, self.begin, self.end)
        self.at = np.searchsorted(self.begin, offsets)
        self.count = np.diff(self.at)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of every window of ``k`` words within one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out += self.hash[j : n - k + 1 + j] * np.uint64(pow(BASE, 2 * j + 1, 2**64))
        owner = np.repeat(np.arange(len(self.count)), self.count)
        inside = owner[: n - k + 1] == owner[k - 1 :]
        first = np.flatnonzero(inside)
        return mixed(out[first]), owner[first], first

    def whole(self) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        n = len(self.hash)
        sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(self.hash * powers(BASE, n), out=sums[1:])
        lo = self.at[:-1]
        inverse = powers(pow(BASE, -1, 2**64), n + 1)
        return mixed((sums[self.at[1:]] - sums[lo]) * inverse[lo] + self.count.astype(np.uint64))


def owned(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys made different between owners, to compare within an owner only."""
    return mixed(keys + mixed(owner.astype(np.uint64) * np.uint64(BASE) + np.uint64(1)))
