"""Texts laid end to end as one byte array, and polynomial hashes of any of its ranges.

The hash of bytes ``s..e`` is ``sum(T[b[i]] * M**(i - s))`` modulo 2**64 with a
table ``T`` of odd random values, got from prefix sums for all ranges at once.
"""

from __future__ import annotations

import numpy as np

M = np.uint64(0x9E3779B97F4A7C15)
M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` for ``i < n``; kept for the next batch."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums (one longer than ``values``) for :func:`ranges`."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(M, len(values)), out=sums[1:])
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges ``start[i]..end[i]`` of what :func:`prefix` got."""
    return mix((sums[end] - sums[start]) * powers(M_INVERSE, len(sums))[start])


def laid_out(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offsets (one more than texts) at which each text begins."""
    sizes = np.array([len(x or b"") for x in texts], np.int64)
    return np.frombuffer(b"".join(x or b"" for x in texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that aren't ASCII white space, within texts."""
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(offsets, start, "right") - 1
