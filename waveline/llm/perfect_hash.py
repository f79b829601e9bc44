"""Minimal perfect hashes over integer keys, built level by level with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEVELS = 24


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 99) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class PerfectHash:
    """Distinct keys to 0..n-1, in about three bits a key.

    A key takes the first level at which it falls on a bit of its own; its
    number is the count of bits before that one. What is left after the last
    level, a key in millions, is numbered from a sorted list.
    """

    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # all levels as bytes
    rest: np.ndarray
    n: int

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = keys.astype(np.int64).view(np.uint64)
        sizes, parts = [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = mix(left, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at.astype(np.int64)]]
        bits = np.concatenate([*parts, np.zeros(0, np.uint8)])
        return cls(np.array(sizes, np.int64), bits, np.sort(left.view(np.int64)), len(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that is not in the set any number, or -1."""
        found = np.full(len(keys), -1, np.int64)
        bit = np.unpackbits(self.bits, bitorder="little").astype(bool)
        rank = np.cumsum(bit) - bit
        open_, start = np.arange(len(keys)), 0
        raw = keys.astype(np.int64).view(np.uint64)
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = start + (mix(raw[open_], level) % np.uint64(size)).astype(np.int64)
            hit = bit[at]
            found[open_[hit]] = rank[at[hit]]
            open_, start = open_[~hit], start + int(size)
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            found[open_[same]] = int(bit.sum()) + at[same]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.sizes), len(self.bits), len(self.rest)], "<i8")
        return head.tobytes() + self.sizes.astype("<i8").tobytes() + self.rest.astype("<i8").tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, levels, n_bits, n_rest = np.frombuffer(raw, "<i8", 4).tolist()
        body = np.frombuffer(raw, "<i8", levels + n_rest, 32)
        return cls(body[:levels], np.frombuffer(raw, np.uint8, n_bits, 32 + 8 * (levels + n_rest)), body[levels:], n)
