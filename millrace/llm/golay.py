"""The perfect binary (23,12) Golay code as a fuzzy hash of 23-bit words.

Every word is within three bits of exactly one codeword. The keys of a word are the codeword
indices of itself and its 23 one-bit neighbours: one key if it is within two bits of its
codeword, six if it is three away. Two words that differ in at most two bits have a word
between them that is a neighbour of both, so they share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR, BITS, CHECK = 0xC75, 23, 11


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


_UNIT = [_remainder(1 << i) for i in range(BITS)]


def _linear(low: int, n: int) -> np.ndarray:
    """Syndromes of the n-bit numbers shifted left by low."""
    out = np.zeros(1 << n, np.int32)
    for i in range(n):
        out[1 << i : 2 << i] = out[: 1 << i] ^ _UNIT[low + i]
    return out


_SYNDROMES = (_linear(0, 8), _linear(8, 8), _linear(16, 7))
_ERRORS = np.zeros(1 << CHECK, np.int32)
for _w in range(1, 4):
    for _bits in combinations(range(BITS), _w):
        _ERRORS[np.bitwise_xor.reduce([_UNIT[i] for i in _bits])] = sum(1 << i for i in _bits)


def syndrome(words: np.ndarray) -> np.ndarray:
    return _SYNDROMES[0][words & 255] ^ _SYNDROMES[1][words >> 8 & 255] ^ _SYNDROMES[2][words >> 16]


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each of the 23-bit words its distinct codeword indices of 12 bits."""
    words = words.astype(np.int32)
    flips = np.array([0] + [1 << i for i in range(BITS)], np.int32)
    units = np.array([0, *_UNIT], np.int32)
    errors = _ERRORS[syndrome(words)[:, None] ^ units]
    index = np.sort((words[:, None] ^ flips ^ errors) >> CHECK, axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    return np.nonzero(new)[0], index[new]
