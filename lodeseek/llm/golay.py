"""The perfect binary Golay code [23, 12, 7] on numpy arrays.

Each 23-bit word lies within three bits of exactly one codeword. A word's *keys* are the codewords
that it and its 23 neighbours decode to: one key if the word is within two bits of its codeword,
six otherwise (5.3 on average). Two words that differ in at most two bits have a word within one bit
of both, hence a key in common.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

WORD_BITS = 23
INDEX_BITS = 12
CHECK_BITS = WORD_BITS - INDEX_BITS
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator polynomial of the code.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word on division by the generator."""
    rest = np.array(words, dtype=np.int64)
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return rest


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of the 2**23 words' low and high halves by XOR, corrections[syndrome, 6], how many of the six differ)."""
    error = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(4):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(WORD_BITS), weight)])
        error[syndrome(patterns)] = patterns
    column = syndrome(1 << np.arange(WORD_BITS))
    corrections = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64)
    count = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for s in range(1 << CHECK_BITS):
        found = {int(error[s])} | {int(error[s ^ int(column[b])]) ^ (1 << b) for b in range(WORD_BITS)}
        ordered = sorted(found)
        count[s] = len(ordered)
        corrections[s] = (ordered + [ordered[0]] * 6)[:6]
    return column, corrections, count


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each word."""
    _, corrections, _ = tables()
    s = syndrome(words)
    nearest = corrections[s]
    weight = np.bitwise_count(nearest)
    pick = np.take_along_axis(nearest, weight.argmin(axis=1)[:, None], axis=1)[:, 0]
    return (words ^ pick) >> CHECK_BITS


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 codeword indices, n counts): the first count[i] entries of row i are the keys of word i."""
    _, corrections, count = tables()
    s = syndrome(words)
    return (words[:, None] ^ corrections[s]) >> CHECK_BITS, count[s]
