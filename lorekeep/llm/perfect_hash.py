"""Minimal perfect hashing of distinct integer keys, built in shards by tasks and looked up in whole arrays.

A shard's keys are hashed into a bit field of twice their number. A bit that one key alone hits is that key's; all others
try again in the next, smaller field. The fields of all shards lie one after another in one bit array, and the number of
set bits before a key's own bit is its index: n keys get the numbers 0 to n - 1. The keys themselves are kept in that
order (32 bits each), so a key that was never put in is told apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lorekeep.llm.common import MIX, mixed

ROOM = 2


def place(keys: np.ndarray, level: int, size: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = mixed(keys.astype(np.uint64) + np.uint64(level + 1) * MIX)
    return (spread % np.asarray(size, np.uint64)).astype(np.int64)


def build_shard(keys: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """(bits of each level, the levels' bits as bytes, keys by index as 32-bit integers) of distinct keys."""
    sizes, fields, order = [], [], []
    left = np.unique(keys)
    while len(left):
        size = max(8, -(-ROOM * len(left) // 8) * 8)
        at = place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        fields.append(np.packbits(alone, bitorder="little"))
        order.append(left[hit][np.argsort(at[hit])])
        sizes.append(size)
        left = left[~hit]
    join = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes() if parts else b""
    return sizes, join(fields, np.uint8), join(order, "<u4")


ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


@dataclass
class PerfectHash:
    """``shards`` in all; those not given hold no keys."""

    shards: int
    sizes: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    before: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, shards: int, built: list[tuple[int, list[int], bytes, bytes]]) -> PerfectHash:
        """From (shard, sizes, bits, keys) of each shard that holds keys."""
        built = sorted(built, key=lambda b: b[0])
        levels = max((len(b[1]) for b in built), default=0)
        sizes = np.zeros((levels, shards), np.int64)
        starts = np.zeros((levels, shards), np.int64)
        at = 0
        for shard, own, _, _ in built:
            for level, size in enumerate(own):
                sizes[level, shard], starts[level, shard] = size, at
                at += size
        bits = np.frombuffer(b"".join(b[2] for b in built), np.uint8)
        before = np.concatenate([[0], np.cumsum(ONES[bits], dtype=np.int64)])[:-1] if len(bits) else np.zeros(0, np.int64)
        return cls(shards, sizes, starts, bits, before.astype(np.uint32), np.frombuffer(b"".join(b[3] for b in built), "<u4"))

    def index(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The index of each key, or -1 for one that was not put in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level in range(len(self.sizes)):
            size = self.sizes[level][shard[open_]]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = place(keys[open_], level, size) + self.starts[level][shard[open_]]
            byte, bit = at >> 3, at & 7
            field = self.bits[byte]
            hit = (field >> bit.astype(np.uint8)) & 1 == 1
            low = field & ((1 << bit) - 1).astype(np.uint8)
            found = self.before[byte].astype(np.int64) + ONES[low]
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        out[~known] = -1
        return out

    def __len__(self) -> int:
        return len(self.keys)
