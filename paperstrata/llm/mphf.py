"""A sharded minimal perfect hash over 128-bit keys, built and probed in numpy.

Keys are pairs of 64-bit hashes. The first selects the shard. Inside a shard the keys go through levels: on each, keys whose
position no other key of the shard has set their bit and stay; the rest go on to the next, smaller level. The number of set
bits before a key's bit is its index, so n keys have the indices 0 to n-1. Fingerprint and count arrays are laid out by index.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64
U = np.uint64


def mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of both hashes for a level."""
    x = a + (b | U(1)) * U((2 * level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(b, a, MAX_LEVELS) >> U(32)).astype(np.uint32)


def shard_of(a: np.ndarray, bits: int) -> np.ndarray:
    return (a >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)


def build(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Of one shard's distinct keys: level sizes (uint32, in 64-bit words), bits (uint64), fingerprints (uint32), counts."""
    sizes, words, order = [], [], []
    rest = np.arange(len(a))
    for level in range(MAX_LEVELS):
        if not len(rest):
            break
        n = max(1, int(np.ceil(len(rest) * GAMMA / 64)))
        at = (mix(a[rest], b[rest], level) % U(n * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=n * 64)[at] == 1
        mine = at[alone]
        bits = np.zeros(n * 64, np.uint8)
        bits[mine] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(rest[alone][np.argsort(mine, kind="stable")])
        sizes.append(n)
        rest = rest[~alone]
    else:
        raise ValueError("keys are not distinct")
    by_index = np.concatenate(order) if order else np.zeros(0, np.int64)
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return np.array(sizes, np.uint32).tobytes(), bits.tobytes(), fingerprint(a, b)[by_index].tobytes(), counts[by_index].tobytes()


class Index:
    """All shards side by side, probed without a loop over shards."""

    def __init__(self, bits: int, shards: list[tuple[int, bytes, bytes, bytes, bytes]], dtype):
        n = 1 << bits
        self.shard_bits = bits
        self.sizes, self.base = np.zeros((MAX_LEVELS, n), np.uint64), np.zeros((MAX_LEVELS, n), np.int64)
        self.first, words, prints, counts, at, keys = np.zeros(n, np.int64), [], [], [], 0, 0
        ones_before = [np.zeros(1, np.int64)]
        self.levels = 0
        for shard, sizes, own, fp, count in sorted(shards, key=lambda s: s[0]):
            level_sizes, own = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(own, np.uint64)
            starts = at + np.concatenate([[0], np.cumsum(level_sizes)[:-1]]) if len(level_sizes) else []
            self.sizes[: len(level_sizes), shard], self.base[: len(level_sizes), shard] = level_sizes * 64, starts
            self.levels = max(self.levels, len(level_sizes))
            self.first[shard] = keys
            words.append(own)
            prints.append(np.frombuffer(fp, np.uint32))
            counts.append(np.frombuffer(count, dtype))
            at, keys = at + len(own), keys + len(prints[-1])
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, dtype)
        self.before = np.concatenate([*ones_before, np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for keys that no shard knows, but for the fingerprint's chance of 2**-32."""
        out = np.zeros(len(a), self.counts.dtype)
        rest, shard = np.arange(len(a)), shard_of(a, self.shard_bits)
        for level in range(self.levels):
            size = self.sizes[level, shard[rest]]
            live = size > 0
            rest, size = rest[live], size[live]
            if not len(rest):
                break
            at = (mix(a[rest], b[rest], level) % size).astype(np.int64)
            word = self.base[level, shard[rest]] + (at >> 6)
            have, low = self.words[word], (at & 63).astype(np.uint64)
            hit = (have >> low) & U(1) == 1
            index = self.before[word[hit]] + np.bitwise_count(have[hit] & ((U(1) << low[hit]) - U(1)))
            known = rest[hit]
            same = self.prints[index] == fingerprint(a[known], b[known])
            out[known[same]] = self.counts[index[same]]
            rest = rest[~hit]
        return out
