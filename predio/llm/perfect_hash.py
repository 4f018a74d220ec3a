"""Minimal perfect hash functions over 64-bit keys, built and probed as arrays.

Keys are thrown into a bit array twice as large as their number; those that fall alone keep
their place, the others go on to the next, smaller array.  A key's number is the count of set
bits before its own.  Each key needs a constant expected number of probes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from predio.llm.words import mix

_U = np.uint64
LEVELS = 40


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + _U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % _U(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Level sizes, the packed bits of all levels, and the set bits before each byte's block."""

    sizes: np.ndarray
    bits: np.ndarray
    before: np.ndarray
    BLOCK = 32

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys; distinct 64-bit keys part for good after a few levels."""
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        sizes, levels, left = [], [], keys
        while len(left):
            size = 2 * len(left)
            place = _place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
            if len(sizes) > LEVELS * 4:
                raise RuntimeError("keys do not part")
        bits = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % cls.BLOCK, np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, cls.BLOCK).sum(1, dtype=np.int64)
        return cls(np.array(sizes, np.int64), bits, np.cumsum(ones) - ones)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, 0 to n - 1; -1 (or any number) for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        left, begin = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = begin + _place(keys[left], level, size)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[left[hit]] = at[hit]
            left, begin = left[~hit], begin + size
        found = np.flatnonzero(out >= 0)
        at = out[found]
        block = (at >> 3) // self.BLOCK
        inside = self.bits.reshape(-1, self.BLOCK)[block] if len(found) else np.zeros((0, self.BLOCK), np.uint8)
        byte = ((at >> 3) % self.BLOCK)[:, None]
        column = np.arange(self.BLOCK)
        part = np.where(column < byte, inside, 0)
        own = np.where(column == byte, inside & ((1 << (at & 7)[:, None]) - 1).astype(np.uint8), 0)
        out[found] = self.before[block] + np.bitwise_count(part | own).sum(1, dtype=np.int64)
        return out
