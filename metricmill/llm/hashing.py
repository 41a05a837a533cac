"""Vectorised hashes of substrings and a minimal perfect hash over fixed keys."""

from __future__ import annotations

import numpy as np

from metricmill.llm.common import runs

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """64-bit hashes of spans of one long sequence of small integers.

    A span's hash is the sum of (symbol's value) * BASE ** (place in the span), modulo 2 ** 64, mixed
    with its length, so it depends on the span's content alone.
    """

    def __init__(self, symbols: np.ndarray):
        values = scatter(symbols.astype(np.uint64) + np.uint64(1))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, len(values)))))
        self.back = powers(BACK, len(values) + 1)

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        raw = (self.prefix[stops] - self.prefix[starts]) * self.back[starts]
        return scatter(raw + scatter((stops - starts).astype(np.uint64)))


def unlike(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each (non-empty) span differs from the span that ``other`` gives its number."""
    lengths = stops - starts
    out = lengths != lengths[other]
    same = np.flatnonzero(~out & (other != np.arange(len(other))))
    if len(same):
        lengths = lengths[same]
        differ = data[runs(starts[same], lengths)] != data[runs(starts[other[same]], lengths)]
        out[same] = np.bitwise_or.reduceat(differ, np.cumsum(lengths) - lengths)
    return out


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: n distinct 64-bit keys to the slots 0 to n - 1, by hash and displace.

    Keys fall into buckets; the largest bucket first, each gets the smallest displacement that puts
    its keys on free slots. Buckets of one key name their slot directly (as a negative number).
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys = np.zeros(n, np.uint64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []
        free = np.ones(n, bool)
        single = []
        for group in sorted(groups, key=len, reverse=True):
            if len(group) == 1:
                single.append(group[0])
                continue
            own = keys[group]
            step = 0
            while True:
                tries = np.arange(step, step + 64, dtype=np.uint64)
                slots = self._slot(own[None, :], tries[:, None])
                good = free[slots].all(axis=1)
                for at in np.flatnonzero(good):
                    if len(set(slots[at].tolist())) == len(group):
                        break
                else:
                    step += 64
                    continue
                break
            self.shift[bucket[group[0]]] = step + at
            free[slots[at]] = False
            self.keys[slots[at]] = own
        for key, slot in zip(single, np.flatnonzero(free)):
            self.shift[bucket[key]] = -slot - 1
            self.keys[slot] = keys[key]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, tries: np.ndarray) -> np.ndarray:
        return (scatter(keys + tries * BASE) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the set."""
        shift = self.shift[self._bucket(keys)]
        slots = np.where(shift < 0, -shift - 1, self._slot(keys, np.maximum(shift, 0).astype(np.uint64)))
        return np.where(self.keys[slots] == keys, slots, -1)
