"""Rolling hashes, winnowed positions and word boundaries as numpy arrays.

All functions take whole arrays; nothing here loops over characters. Polynomial
hashes are taken modulo 2**64 over units that were spread to 64 random bits, and
are mixed at the end, as the low bits of the polynomial alone are weak.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
WORD_BASE = 0xD1342543DE82EF95
STEP = 1 << 20


@lru_cache(maxsize=8)
def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=U) * U(2) + U(1)


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(size, b, U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit word over all bits; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Hashes of any substring of a sequence of 64-bit units.

    Two sequences with the same units have the same hash wherever they stand.
    """

    def __init__(self, units: np.ndarray, base: int = BASE):
        size = -(-max(len(units) + 1, 1) // STEP) * STEP
        self.up, self.down = powers(base, size)
        self.sums = np.zeros(len(units) + 1, U)
        np.cumsum(units * self.up[: len(units)], out=self.sums[1:])

    def grams(self, length: int) -> np.ndarray:
        """Hash of every stretch of this length, by its start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by the first of them, in three passes."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w grams the place of its least one, the leftmost of equals.

    The choice depends on the run's content alone, so equal runs choose the same
    place. Grams are ordered by their upper 40 bits and then by place.
    """
    parts, piece = [], 1 << 22
    for at in range(0, max(len(grams) - w + 1, 0), piece):
        here = grams[at : at + piece + w - 1]
        least = sliding_min((here & U(0xFFFFFFFFFF000000)) | np.arange(len(here), dtype=U), w)
        parts.append((least & U(0xFFFFFF)).astype(np.int64) + at)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Marks of the places in any of the intervals."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals as maximal ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]
