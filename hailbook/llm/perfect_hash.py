"""A minimal perfect hash over byte strings: n keys, n slots, looked up for whole arrays at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from hailbook.llm.arrays import mix, prefix_sums, span_hash

_STEP = np.uint64(0xA24BAED4963EE407)


def flatten(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the keys and the offsets between them."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), offsets[:-1], offsets[1:]) ^ mix(np.diff(offsets).astype(np.uint64))


@dataclass
class PerfectHash:
    """``displacements``: by bucket, a step >= 0 for hash and displace, or -1 - slot for a bucket of one key."""

    displacements: np.ndarray
    key_at: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def build(keys: list[bytes], per_bucket: int = 3) -> PerfectHash:
        data, offsets = flatten(keys)
        h, n = hashes(data, offsets), len(keys)
        if len(np.unique(h)) < n:
            raise ValueError("keys must be distinct")
        buckets = max(1, n // per_bucket)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        steps, key_at, free = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[begins[b] : begins[b + 1]]
            if len(own) < 2:
                break
            first = 0
            while True:
                tries = np.arange(first, first + 64)
                slots = _slots(h[own][:, None], tries[None, :], n)
                good = free[slots].all(axis=0)
                ordered = np.sort(slots, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    at = int(np.flatnonzero(good)[0])
                    steps[b] = first + at
                    free[slots[:, at]] = False
                    key_at[slots[:, at]] = own
                    break
                first += 64
        single = np.flatnonzero(sizes == 1)
        slots = np.flatnonzero(free)[: len(single)]
        steps[single] = -1 - slots
        key_at[slots] = order[begins[single]]
        return PerfectHash(steps, key_at, data, offsets)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key among the built ones, -1 for others; hits are compared byte by byte."""
        if not keys or not len(self.key_at):
            return np.full(len(keys), -1)
        data, offsets = flatten(keys)
        h = hashes(data, offsets)
        step = self.displacements[(h % np.uint64(len(self.displacements))).astype(np.int64)]
        slot = np.where(step < 0, -1 - step, _slots(h, np.maximum(step, 0), len(self.key_at)))
        found = self.key_at[slot]
        lengths = np.diff(offsets)
        same = np.diff(self.offsets)[found] == lengths
        some = np.flatnonzero(same)
        within = np.arange(lengths[some].sum()) - np.repeat(np.cumsum(lengths[some]) - lengths[some], lengths[some])
        ours = data[np.repeat(offsets[some], lengths[some]) + within]
        theirs = self.data[np.repeat(self.offsets[found[some]], lengths[some]) + within]
        wrong = np.repeat(np.arange(len(some)), lengths[some])[ours != theirs]
        same[some[wrong]] = False
        return np.where(same, found, -1)


def _slots(h: np.ndarray, steps: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + (steps.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(n)).astype(np.int64)
