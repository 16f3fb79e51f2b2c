"""A minimal perfect hash over distinct unsigned 64-bit keys, as numpy arrays.

Keys are thrown into twice as many places as there are keys; those that fall alone keep their place, and the others go on to the next level. A key's slot is
the number of kept places before its own. Slots run from 0 without gaps. Keys that weren't given get any slot or -1, so callers store the keys by slot
and compare.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well spread 64-bit values of the keys, others for each seed."""
    x = (keys ^ (keys >> np.uint64(31))) * (_A + np.uint64(2 * seed))
    x = (x ^ (x >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _places(keys: np.ndarray, seed: int, n: int) -> np.ndarray:
    return ((mixed(keys, seed) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class PerfectHash:
    def __init__(self, keys: np.ndarray, depth: int = 48):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size, left = len(keys), keys.astype(np.uint64)
        given = 0
        for seed in range(depth):
            if not len(left):
                break
            n = -(-2 * len(left) // 64) * 64
            at = _places(left, seed, n)
            alone = np.bincount(at.astype(np.int64), minlength=n) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((n, bits, given + np.cumsum(ones) - ones))
            given += int(ones.sum())
            left = left[~alone[at]]
        self.left, self.given = np.sort(left), given  # none, but for keys that no level sets apart

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (n, bits, before) in enumerate(self.levels):
            if not len(todo):
                return out
            at = _places(keys[todo], seed, n)
            word, bit = bits[at >> np.uint64(6)], at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = before[at[hit] >> np.uint64(6)] + below
            todo = todo[~hit]
        if len(self.left) and len(todo):
            k = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            same = self.left[k] == keys[todo]
            out[todo[same]] = self.given + k[same]
        return out
