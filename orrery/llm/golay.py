"""The binary Golay code (23, 12, 7): every 23-bit word is within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

N, K = 23, 12
#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(N - 1, N - K - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - (N - K)))
    return rest


@lru_cache(maxsize=1)
def decode_table() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of its nearest codeword."""
    errors = np.zeros(1 << (N - K), dtype=np.int32)
    patterns = np.array([sum(1 << i for i in c) for r in range(4) for c in combinations(range(N), r)], dtype=np.int32)
    errors[_remainder(patterns)] = patterns
    words = np.arange(1 << N, dtype=np.int32)
    return ((words ^ errors[_remainder(words)]) >> (N - K)).astype(np.int16)


def nearby_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word and of its neighbours one bit away.

    Only the low ``bits`` bits are flipped: a shorter segment has no errors in its padding.
    """
    flips = np.array([0, *(1 << i for i in range(bits))], dtype=words.dtype)
    found = np.sort(decode_table()[words[:, None] ^ flips], axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(new)
    return row, found[row, column]
