"""The binary Golay code (23, 12) as a fuzzy hash.

The code is perfect: each 23-bit word lies within 3 bits of exactly one codeword. A word's keys
are the codewords within 4 bits: one, or six if the nearest is 3 bits away. Words that differ in
2 bits or fewer share a key (any 4 positions lie in exactly one codeword of weight 7, so if both
are 3 bits from their nearest, one of the five further codewords is near to both).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainders() -> np.ndarray:
    """Remainder of each single bit by the generator."""
    out = []
    for k in range(BITS):
        x = 1 << k
        for high in range(BITS - 1, CHECK - 1, -1):
            if x >> high & 1:
                x ^= GENERATOR << (high - CHECK)
        out.append(x)
    return np.array(out, np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits joined in one table, and the error patterns of
    weight 4 or less of each syndrome (padded by repeating the first)."""
    single = _remainders()
    syndrome = np.zeros(1 << BITS, np.int16)
    for k in range(BITS):
        syndrome[1 << k : 2 << k] = syndrome[: 1 << k] ^ single[k]
    errors: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            x = sum(1 << p for p in places)
            errors[int(syndrome[x])].append(x)
    return syndrome, np.array([(e + [e[0]] * 6)[:6] for e in errors], np.int64)


_CACHE: list = []


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 12-bit index of a codeword within 4 bits) for each of the 23-bit ``words``."""
    if not _CACHE:
        _CACHE.extend(_tables())
    syndrome, errors = _CACHE
    near = errors[syndrome[words]]
    index = (words[:, None] ^ near) >> CHECK
    real = np.ones(near.shape, bool)
    real[:, 1:] = near[:, 1:] != near[:, :1]
    return np.nonzero(real)[0], index[real]
