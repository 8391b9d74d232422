"""XXH64 of many slices of one byte buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Slices that are hashed side by side, and the length from which a slice goes through the library on its own.
TOGETHER, LONG = 1 << 16, 1 << 10


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotated(x * P2, 31) * P1


def _some(data: np.ndarray, eights: np.ndarray, fours: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of slices in descending order of length, so those with a further stripe come first."""
    seed_ = np.full(1, seed, np.uint64)
    h = np.full(len(start), seed_ + P5, np.uint64)
    stripes = length >> 5
    n = int(np.count_nonzero(stripes))
    if n:
        lanes = [np.full(n, v, np.uint64) for v in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
        for k in range(int(stripes[0])):
            more = int(np.searchsorted(-stripes[:n], -k, "left"))
            at = start[:more] + 32 * k
            for i, v in enumerate(lanes):
                v[:more] = _rotated(v[:more] + eights[at + 8 * i] * P2, 31) * P1
        acc = sum((_rotated(v, by) for v, by in zip(lanes, (1, 7, 12, 18))), np.zeros(n, np.uint64))
        for v in lanes:
            acc = (acc ^ _lane(v)) * P1 + P4
        h[:n] = acc
    h += length.astype(np.uint64)
    at = start + (length & ~31)
    for k in range(3):
        has = np.flatnonzero((length & 31) >> 3 > k)
        h[has] = _rotated(h[has] ^ _lane(eights[at[has] + 8 * k]), 27) * P1 + P4
    at = start + (length & ~7)
    has = np.flatnonzero(length & 4)
    h[has] = _rotated(h[has] ^ (fours[at[has]].astype(np.uint64) * P1), 23) * P2 + P3
    at = start + (length & ~3)
    for k in range(3):
        has = np.flatnonzero((length & 3) > k)
        h[has] = _rotated(h[has] ^ (data[at[has] + k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of data[start:end] for each slice; slices may overlap and stand in any order."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    for at in range(0, len(starts), TOGETHER):
        start = starts[at : at + TOGETHER]
        length = ends[at : at + TOGETHER] - start
        order = np.argsort(-np.minimum(length, LONG).astype(np.int16), kind="stable")
        far = int(np.count_nonzero(length >= LONG))
        own = np.empty(len(start), np.uint64)
        for i in order[:far]:
            own[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
        rest = order[far:]
        if len(rest):
            own[rest] = _some(padded, eights, fours, start[rest], length[rest], seed)
        out[at : at + TOGETHER] = own
    return out
