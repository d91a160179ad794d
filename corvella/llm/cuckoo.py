"""A cuckoo filter over 128-bit keys, with insertion, deletion and lookup of whole batches by numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Buckets of ``SLOTS`` 16-bit fingerprints. False positives happen (about 8 in 65,536), false negatives never.

    Equal keys may be inserted up to 2 * SLOTS times; callers insert distinct keys. When placing fails the
    table doubles: fingerprints can't be rehashed, so the caller's keys are needed; ``build`` does that.
    """

    def __init__(self, buckets: int):
        self.n = 1 << max(1, int(buckets - 1).bit_length())
        self.table = np.zeros((self.n, SLOTS), dtype=np.uint16)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "CuckooFilter":
        size = max(2, int(len(h1) / SLOTS / 0.8) + 1)
        while not (out := cls(size)).insert(h1, h2):
            size = out.n * 2
        return out

    def _places(self, h1, h2):
        a, b = np.asarray(h1).view(np.uint64), np.asarray(h2).view(np.uint64)
        fp = (b >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (a ^ (b << np.uint64(1))) * _MIX >> np.uint64(20)
        return fp, (first & np.uint64(self.n - 1)).astype(np.int64)

    def _other(self, bucket, fp):
        step = (fp.astype(np.uint64) * _MIX >> np.uint64(24)).astype(np.int64)
        return (bucket ^ step) & (self.n - 1)

    def insert(self, h1, h2, rounds: int = 500) -> bool:
        """Places all keys, or returns False with the table unusable when it is too full."""
        fp, at = self._places(h1, h2)
        rng = np.random.default_rng(7)
        for turn in range(rounds):
            if not len(fp):
                return True
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            # the rank of each key among those that want the same bucket
            starts = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            slots = self.table[at]
            free = slots == 0
            fits = rank < free.sum(1)
            nth = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], axis=1)
            self.table[at[fits], nth[fits]] = fp[fits]
            fp, at, rank = fp[~fits], at[~fits], rank[~fits]
            if turn % 2 == 0:  # first the other bucket, then one eviction a bucket
                at = self._other(at, fp)
                continue
            heads = np.r_[True, np.diff(at) != 0] if len(at) else np.zeros(0, bool)
            full = heads & (self.table[at] != 0).all(1)
            slot = rng.integers(0, SLOTS, full.sum())
            out = self.table[at[full], slot].copy()
            self.table[at[full], slot] = fp[full]
            fp[full] = out
            at = self._other(at, fp)
        return not len(fp)

    def contains(self, h1, h2) -> np.ndarray:
        fp, at = self._places(h1, h2)
        hit = (self.table[at] == fp[:, None]).any(1)
        return hit | (self.table[self._other(at, fp)] == fp[:, None]).any(1)

    def delete(self, h1, h2) -> int:
        """Removes one fingerprint for each key; only keys that were inserted may be given. Returns how many went."""
        fp, at = self._places(h1, h2)
        gone = 0
        for turn in range(2 * SLOTS + 2):  # keys of one bucket and fingerprint go one at a turn
            if not len(fp):
                break
            other = self._other(at, fp)
            here = (self.table[at] == fp[:, None]).any(1)
            bucket = np.where(here, at, other)
            hit = self.table[bucket] == fp[:, None]
            slot = bucket * SLOTS + hit.argmax(1)
            found = hit.any(1)
            _, first = np.unique(np.where(found, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[found[first]]
            self.table.reshape(-1)[slot[first]] = 0
            gone += len(first)
            rest = found.copy()
            rest[first] = False
            fp, at = fp[rest], at[rest]
        return gone

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "CuckooFilter":
        out = cls(len(blob) // (2 * SLOTS))
        out.table = np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return out
