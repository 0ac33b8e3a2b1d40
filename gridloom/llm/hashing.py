"""Vectorised 64-bit hashes: of words, and rolling ones that select places but never decide that bytes are equal."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import SLICE_BYTES

_MULTIPLIER = 0x9E3779B97F4A7C15


#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 64


class Rolling:
    """Fingerprints of any range of a byte array, from prefix sums of a polynomial over a seeded table, modulo 2^64.

    Different strings of some hundred bytes can be made to agree, so these only choose places (anchors) and deal rows.
    """

    table = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, SLICE_BYTES // 4, min(2 * len(cls.up), SLICE_BYTES))
            one = np.full(n, _MULTIPLIER, np.uint64)
            back = np.full(n, pow(_MULTIPLIER, -1, 2**64), np.uint64)
            one[0] = back[0] = 1
            cls.up, cls.down = np.multiply.accumulate(one), np.multiply.accumulate(back)

    def __init__(self, data: np.ndarray):
        self.grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]: eight bytes at a time go through a mixing that isn't linear, long words through BLAKE2."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    size = end - start
    out = mixed(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = start[live], size[live]
    while len(live):
        part = eight[at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        out[live] = mixed(out[live] * np.uint64(_MULTIPLIER) ^ mixed(part + np.uint64(0x9E6C63D0676A9A99)))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    raw = memoryview(data)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x
