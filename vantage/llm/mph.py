"""Minimal perfect hashing of 128-bit keys in numpy: levels of bit arrays, each for the keys that collided above it."""

from __future__ import annotations

import struct

import numpy as np

from vantage.llm.arrays import U64, mix

SPREAD = 2  # bits a key in each level
LEVELS = 40


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys[:, 0] + U64(level) * (keys[:, 1] | U64(1))) % U64(bits)).astype(np.int64)


def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Pack distinct keys (n x 2 of uint64) and their counts: bit levels, then a fingerprint and a count a slot."""
    left, levels = np.arange(len(keys)), []
    slot = np.zeros(len(keys), np.int64)
    base = 0
    for level in range(LEVELS):
        if not len(left):
            break
        bits = max(64, -(-SPREAD * len(left) // 64) * 64)
        spot = _spot(keys[left], level, bits)
        many = np.bincount(spot, minlength=bits)
        alone = many[spot] == 1
        on = many == 1
        words = np.packbits(on, bitorder="little").view("<u8")
        slot[left[alone]] = base + np.cumsum(on)[spot[alone]] - 1
        base += int(on.sum())
        levels.append(words)
        left = left[~alone]
    slot[left] = base + np.arange(len(left))  # keys that no level could tell apart: looked through one by one
    print_, count = np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
    print_[slot] = keys[:, 1]
    count[slot] = np.minimum(counts, 0xFFFFFFFF)
    head = struct.pack("<III", len(keys), len(levels), len(left))
    sizes = np.array([len(x) for x in levels], "<u4").tobytes()
    return b"".join([head, sizes, *(x.tobytes() for x in levels), print_.tobytes(), count.tobytes()])


class Index:
    """A packed shard, ready to be probed."""

    def __init__(self, raw: bytes):
        n, levels, rest = struct.unpack_from("<III", raw)
        at = 12 + 4 * levels
        self.levels = []
        base = 0
        for size in np.frombuffer(raw, "<u4", levels, 12).tolist():
            words = np.frombuffer(raw, "<u8", size, at)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
            at += 8 * size
        self.prints = np.frombuffer(raw, "<u8", n, at)
        self.counts = np.frombuffer(raw, "<u4", n, at + 8 * n)
        self.rest = rest

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count kept for each key; 0 where the fingerprint is another's."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level, (words, before) in enumerate(self.levels):
            if not len(left):
                return out
            spot = _spot(keys[left], level, 64 * len(words))
            word, bit = words[spot >> 6], (spot & 63).astype(U64)
            on = ((word >> bit) & U64(1)).astype(bool)
            slot = before[spot[on] >> 6] + np.bitwise_count(word[on] & ((U64(1) << bit[on]) - U64(1))).astype(np.int64)
            found = left[on]
            out[found] = np.where(self.prints[slot] == keys[found, 1], self.counts[slot], 0)
            left = left[~on]
        for k in range(len(self.prints) - self.rest, len(self.prints)):
            out[left[keys[left, 1] == self.prints[k]]] = self.counts[k]
        return out
