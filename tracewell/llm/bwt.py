"""Repeated windows of a text by its Burrows-Wheeler transform, and the anchors that bring equal windows together.

``repeat_classes`` finds which rotations of a text share their first ``least`` bytes: intervals of the transform are extended
backwards by every byte breadth first, so common prefixes appear by increasing length, and the search stops at ``least``.
``anchors`` chooses, for each window of ``least`` bytes, the place of its least k-gram; equal windows choose alike.
"""

from __future__ import annotations

import numpy as np

def rotations(text: np.ndarray, least: int) -> np.ndarray:
    """Starts of the rotations of a byte array, sorted by their first ``least`` bytes or more, so backward extension is exact up to there."""
    n = len(text)
    ring = np.resize(text, n + 8)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | ring[k : k + n].astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if width >= least or new[order[-1]] == n - 1:
            return order
        key = new.astype(np.uint64) << np.uint64(32) | np.roll(new, -(width % n)).astype(np.uint64)
        width *= 2


class Wavelet:
    """A wavelet matrix of bytes: all (interval, byte) pairs of many intervals at once."""

    def __init__(self, data: np.ndarray):
        self.ranks, self.zeros = [], []
        counts = np.bincount(data, minlength=256)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:256]
        for bit in range(7, -1, -1):
            ones = (data >> bit & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(int(len(data) - self.ranks[-1][-1]))
            data = np.concatenate([data[~ones], data[ones]])
        heads = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]])) if len(data) else np.empty(0, np.int64)
        self.first = np.zeros(256, np.int64)
        self.first[data[heads]] = heads

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of every byte put before the strings of intervals [lo, hi)."""
        byte = np.zeros(len(lo), np.int64)
        for rank, zero in zip(self.ranks, self.zeros, strict=True):
            a, b = rank[lo].astype(np.int64), rank[hi].astype(np.int64)
            left, right = (hi - b) > (lo - a), b > a
            lo, hi = np.concatenate([(lo - a)[left], zero + a[right]]), np.concatenate([(hi - b)[left], zero + b[right]])
            byte = np.concatenate([byte[left] << 1, byte[right] << 1 | 1])
        shift = self.before[byte] - self.first[byte]
        return lo + shift, hi + shift


def repeat_classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted rotations, class of each): rotations are of one class if their first ``least`` bytes are equal."""
    n = len(text)
    order = rotations(text, least)
    wavelet = Wavelet(text[order - 1])
    apart = np.zeros(n + 1, bool)  # whether a rotation's common prefix with the one before is known to be shorter
    apart[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        lo, hi = wavelet.extend(lo, hi)
        new = ~apart[hi]
        lo, hi = lo[new], hi[new]
        hi, at = np.unique(hi, return_index=True)
        lo = lo[at]
        apart[hi] = True
        if not len(hi):
            break
    return order, np.cumsum(apart[:-1]) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """64-bit hashes of the bytes at each place, for each size, by doubling."""
    level, width = _mix(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    totals, offsets = [np.zeros(max(0, len(data) - k + 1), np.uint64) for k in sizes], [0] * len(sizes)
    while True:
        for i, k in enumerate(sizes):
            if k & width:
                part = level[offsets[i] : offsets[i] + len(totals[i])]
                totals[i] = part.copy() if not offsets[i] else _mix(totals[i] * np.uint64(0x94D049BB133111EB) + part)
                offsets[i] += width
        if width * 2 > max(sizes) or len(level) <= width:
            return totals
        level = _mix(level[:-width] * np.uint64(0xBF58476D1CE4E5B9) + level[width:])
        width *= 2


#: Places that fit beside the hash in ``anchors``.
PLACES = 24


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbouring hashes, the place of the least by its high bits (the first of equals)."""
    n, low = len(hashes), np.uint64((1 << PLACES) - 1)
    if n > 1 << PLACES:
        raise ValueError("too many hashes for one call")
    best, span = (hashes & ~low) | np.arange(n, dtype=np.uint64), 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: n - width + 1], best[width - span :])
    return (best & low).astype(np.int64)
