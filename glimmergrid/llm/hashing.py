"""Vectorised hashes of the words of a text, for use inside tasks."""

from __future__ import annotations

import numpy as np

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 0x100000001B3

_kept: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(factor: int, n: int) -> np.ndarray:
    """``factor`` to the powers 0, 1, 2, ... modulo 2 ** 64."""
    if len(_kept.get(factor, ())) < n:
        powers = np.full(max(n, 1 << 16), factor, np.uint64)
        powers[0] = 1
        _kept[factor] = np.multiply.accumulate(powers)
    return _kept[factor][:n]


def words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in bytes: runs of anything but ASCII white space."""
    space = SPACES[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    values = mixed(b.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_powers(STEP, len(b)) * values, dtype=np.uint64)))
    found = (sums[ends] - sums[starts]) * _powers(pow(STEP, -1, 1 << 64), len(b))[starts]
    return starts, ends, found


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
