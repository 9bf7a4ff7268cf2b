"""The binary (23, 12) Golay code as a fuzzy hash: words that differ in few bits share a codeword near both.

A 23-bit word whose nearest codeword is at distance 3 has five more at distance 4; those six give it six keys, any other
word has the one nearest codeword. Two words at distance 2 or less always share a key."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

LENGTH, DIMENSION, MOST_KEYS = 23, 12, 6
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - (LENGTH - DIMENSION))
    return word


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome by byte and byte value, error patterns by syndrome, -1 where there are fewer than six)."""
    single = [_remainder(1 << i) for i in range(LENGTH)]
    by_byte = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for value in range(256):
            s = 0
            for bit in range(8):
                if value >> bit & 1 and byte * 8 + bit < LENGTH:
                    s ^= single[byte * 8 + bit]
            by_byte[byte, value] = s
    near: list[list[int]] = [[] for _ in range(1 << (LENGTH - DIMENSION))]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = e = 0
            for b in bits:
                s ^= single[b]
                e |= 1 << b
            near[s].append(e)
    patterns = np.full((len(near), MOST_KEYS), -1, np.int64)
    for s, errors in enumerate(near):
        patterns[s, : len(errors)] = errors
    return by_byte, patterns


def decode(words: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) near each word, with a last axis of six; -1 where a word has fewer."""
    by_byte, patterns = tables()
    w = words.astype(np.int64)
    errors = patterns[by_byte[0, w & 255] ^ by_byte[1, w >> 8 & 255] ^ by_byte[2, w >> 16 & 255]]
    return np.where(errors < 0, -1, (w[..., None] ^ errors) >> (LENGTH - DIMENSION))
