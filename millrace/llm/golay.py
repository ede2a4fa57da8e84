"""Fuzzy keys from the perfect binary [23,12] Golay code.

Every 23-bit word lies within 3 bits of exactly one code word.  The keys of a
word are the 12-bit indices of all code words within 4 bits of it: one, or six
for most words.  Two words at most 2 bits apart have a key in common, because
some word lies within 1 bit of both, and that word's code word lies within
3 + 1 bits of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BITS, CHECK = 23, 11
REACH = 4


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unit = [_remainder(1 << b) for b in range(BITS)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for table, shift in ((low, 0), (high, 12)):
        for b in range(len(table).bit_length() - 1):
            table[1 << b : 2 << b] = table[: 1 << b] ^ unit[shift + b]
    found: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(REACH + 1):
        for bits in combinations(range(BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            found[syndrome].append(sum(1 << b for b in bits))
    errors = np.full((1 << CHECK, max(map(len, found))), -1, np.int64)
    for syndrome, words in enumerate(found):
        errors[syndrome, : len(words)] = words
    return low, high, errors


_made: list = []


def keys(words: np.ndarray) -> np.ndarray:
    """One row for each 23-bit word: indices of the code words within reach, -1 where there are fewer."""
    if not _made:
        _made.extend(_tables())
    low, high, errors = _made
    words = words.astype(np.int64)
    patterns = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> CHECK)
