"""Bit vectors with rank and select, and a wavelet matrix over a few symbols, for whole arrays of queries at a time."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed into 64-bit words, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(self.size // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self._words = words
        self._before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """Ones before each end."""
        word, bit = ends >> 6, (ends & 63).astype(np.uint64)
        low = self._words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self._before[word] + np.bitwise_count(low)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The place of the one before which number ones stand; size if there is none."""
        return first_reaching(self.rank, np.zeros_like(number), np.full_like(number, self.size), number + 1)


def first_reaching(count, low: np.ndarray, high: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """For each row, by bisection, the first place from low on with count(place + 1) >= goal; high if there is none."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high) >> 1
        enough = count(np.minimum(middle + 1, high)) >= goal
        high = np.where(enough, middle, high)
        low = np.where(enough | (low >= high), low, middle + 1)
    return low


class WaveletMatrix:
    """Symbols of so many bits: one bit vector a bit, highest first, each level's zeros sorted before its ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self._levels = len(symbols), []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self._levels.append((BitVector(ones), int(self.size - ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each end."""
        first = np.zeros_like(ends)
        for level, (ones, zeros) in enumerate(self._levels):
            a, z = ones.rank(first), ones.rank(ends)
            if symbol >> (len(self._levels) - 1 - level) & 1:
                first, ends = zeros + a, zeros + z
            else:
                first, ends = first - a, ends - z
        return ends - first
