"""Minimal perfect hash over 128-bit keys, with NumPy.

Levels of bit arrays: at each level every remaining key hashes to one of
about twice as many cells; keys alone in their cell settle there, the others
go on to the next level. A key's number is the count of set bits before its
own, so n keys get the numbers 0 to n - 1 in about three bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def _cells(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    x = high ^ (low + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, bits
        self.set = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(sizes)].astype(bool)
        self.rank = np.cumsum(self.set, dtype=np.int64) - 1

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Keys (two uint64 arrays) must be distinct."""
        sizes, levels = [], []
        while len(high):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("equal keys")
            size = max(8, int(GAMMA * len(high)))
            at = _cells(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = ~alone[at]
            high, low = high[rest], low[rest]
        return cls(sizes, np.packbits(np.concatenate(levels)).tobytes() if levels else b"")

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Numbers; -1 where a key settles nowhere (it was not among the keys)."""
        out, left, start = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + _cells(high[left], low[left], level, size)
            hit = self.set[at]
            out[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + size
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}I", len(self.sizes), *self.sizes) + self.bits

    @classmethod
    def from_bytes(cls, b: bytes) -> PerfectHash:
        n = struct.unpack_from("<I", b)[0]
        return cls(list(struct.unpack_from(f"<{n}I", b, 4)), b[4 + 4 * n:])
