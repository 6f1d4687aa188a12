"""Minimal perfect hashing of 64-bit keys, whole arrays at a time (numpy only).

Keys are thrown at a bit array of twice their number. Keys that hit a place alone own its bit; the others go on to the next,
smaller level with another seed. A key's number is the count of bits before its own over all levels, so ``n`` keys get
the numbers 0 to n - 1. The few keys left after the last level are kept in a sorted list.
"""

from __future__ import annotations

import numpy as np

from gristmill.llm.hashing import mix

LEVELS = 24
_STEP = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((_STEP * (level + 1)) & (2**64 - 1))
    return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers of known keys; any other key gets some number or -1, so callers verify the key that a number stands for."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest, self.ranks = bits, rest, []
        before = 0
        for words in bits:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        self.first_rest = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """From distinct keys in any order."""
        left, bits = keys.astype(np.uint64), []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = _places(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, words in enumerate(self.bits):
            if not len(todo):
                return out
            at = _places(keys[todo], level, len(words) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = words[word]
            owned = (value >> bit) & np.uint64(1) == 1
            below = value[owned] & ((np.uint64(1) << bit[owned]) - np.uint64(1))
            out[todo[owned]] = self.ranks[level][word[owned]] + np.bitwise_count(below)
            todo = todo[~owned]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            found = self.rest[at] == keys[todo]
            out[todo[found]] = self.first_rest + at[found]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), *map(len, self.bits), len(self.rest)], np.uint64)
        return b"".join(x.tobytes() for x in (head, *self.bits, self.rest))

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        words = np.frombuffer(data, np.uint64)
        levels = int(words[0])
        parts = np.split(words[levels + 2:], np.cumsum(words[1:levels + 2].astype(np.int64))[:-1]) if levels else [words[2:]]
        return cls(parts[:levels], parts[levels])
