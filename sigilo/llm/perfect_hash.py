"""Minimal perfect hash of 128-bit keys, and arrays that it indexes.

Keys are placed level by level: on each level every key that is left has one
bit of an array twice as long as their number, and keys that have a bit to
themselves are done. A key's slot is the rank of its bit over all levels, so n
keys have the slots 0 to n - 1 and some four bits each are kept of them.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that is left; the shortest level; levels that no set of distinct keys gets near.
ROOM, SHORTEST, LEVELS = 2, 64, 200
ODD, WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
MIX = np.uint64(0xD6E8FEB86659FD93)


def places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of every key on a level."""
    x = high * np.uint64((ODD * (2 * level + 1)) & WORD) + low
    x ^= x >> np.uint64(32)
    x *= MIX
    x ^= x >> np.uint64(29)
    return x % np.uint64(size)


class PerfectHash:
    """Slots of a fixed set of distinct keys (two arrays of unsigned 64 bits)."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.before = np.concatenate(([0], before))

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(high):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(SHORTEST, -(-ROOM * len(high) // 64) * 64)
            at = places(high, low, len(sizes), size)
            own = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(own, bitorder="little").view("<u8"))
            left = ~own[at]
            high, low = high[left], low[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of every key; some slot, or -1, for a key that is not of the set."""
        out = np.full(len(high), -1, dtype=np.int64)
        left, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = places(high[left], low[left], level, size)
            word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left, base = left[~hit], base + size // 64
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<u8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        all_words = np.frombuffer(raw, "<u8")
        n = int(all_words[0])
        return cls([int(x) for x in all_words[1 : n + 1]], all_words[n + 1 :])


class CountIndex:
    """Fingerprints, counts and last identifiers of a set of keys, in arrays by slot.

    A fingerprint has 32 bits, a count one byte (255: so many or more); an
    identifier is kept only where the count reaches ``least``.
    """

    def __init__(self, raw: bytes) -> None:
        self.least, self.n, hashed = (int(x) for x in np.frombuffer(raw[:24], "<u8"))
        self.slots_of = PerfectHash.from_bytes(raw[24 : 24 + hashed])
        at = 24 + hashed
        self.fingerprints = np.frombuffer(raw, "<u4", self.n, at)
        self.counts = np.frombuffer(raw, "u1", self.n, at + 4 * self.n)
        self.frequent = self.counts >= self.least
        self.rank = np.cumsum(self.frequent) - 1
        self.last = np.frombuffer(raw[at + 5 * self.n :], "<i8")

    @staticmethod
    def build(high: np.ndarray, low: np.ndarray, count: np.ndarray, last: np.ndarray, least: int) -> bytes:
        """The index as bytes; ``least`` is below 255."""
        hashed = PerfectHash.build(high, low)
        slot = hashed.slots(high, low)
        order = np.empty(len(high), dtype=np.int64)
        order[slot] = np.arange(len(high))
        count, raw = np.minimum(count[order], 255).astype("u1"), hashed.to_bytes()
        prints = (low[order] >> np.uint64(32)).astype("<u4")
        return b"".join((np.array([least, len(high), len(raw)], "<u8").tobytes(), raw, prints.tobytes(), count.tobytes(), last[order][count >= least].astype("<i8").tobytes()))

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, last) of every key; the last is of use where the count reaches ``least`` only."""
        slot = self.slots_of.slots(high, low)
        known = slot >= 0
        slot = np.where(known, slot, 0)
        if not self.n:
            return known, np.zeros(len(high), "u1"), np.zeros(len(high), np.int64)
        known &= self.fingerprints[slot] == (low >> np.uint64(32)).astype("<u4")
        count = np.where(known, self.counts[slot], 0)
        many = known & self.frequent[slot]
        last = np.zeros(len(high), np.int64)
        last[many] = self.last[self.rank[slot[many]]]
        return known, count, last
