"""Word shingles of whole texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from .cache import Recent

U64 = np.uint64
#: Cached words per generation.
CACHE_WORDS = 300_000


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class Shingler:
    """Distinct ``width``-word shingles of a text: sorted unique 64-bit hashes.

    Words are the runs outside ``[\\x20\\x09-\\x0D]`` (what ``bytes.split``
    cuts at) with A-Z in lower case. A text of fewer words is one shingle; a
    text without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self.hashes = Recent(xxhash.xxh64_intdigest, CACHE_WORDS)
        self.factors = odd_multipliers(width + 1, 11)

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(ws)
        if not n:
            return np.empty(0, U64)
        h = np.fromiter(map(self.hashes.__getitem__, ws), U64, n)
        k = min(n, self.width)
        out = self.factors[self.width] * np.full(n - k + 1, k, U64)
        for j in range(k):
            out += h[j:n - k + 1 + j] * self.factors[j]
        return np.unique(mix(out))
