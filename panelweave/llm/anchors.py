"""Anchors: content-chosen byte positions, at least one in every string of a fixed length.

Of the k-byte strings inside a window of ``length`` bytes, the one with the smallest hash (the leftmost of
equals) is the window's anchor. Equal windows have their anchor at the same place, wherever they stand, and
windows that start close to each other mostly share it.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, dtype=np.uint64)


class Hasher:
    """Hashes of any substrings of a buffer, from running sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[data] * powers(BASE, n), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:len(self.sums) - k])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1), kept between calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n + 1:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(have)
    return have[:n + 1] if base == INVERSE else have[:n]


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``w`` values, by doubling widths."""
    best = np.arange(len(values))
    low, width = values, 1
    while width < w:
        step = min(width, w - width)
        right = low[step:] < low[:-step]
        best = np.where(right, best[step:], best[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    return best


def anchors(hashes: np.ndarray, w: int, document: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions with the first and last window start each serves.

    ``hashes`` are those of the k bytes from each position, ``document`` tells the bytes of one document
    from those of the next; windows that cross into the next one are left out.
    """
    best = window_argmin(hashes, w)
    whole = document[:len(best)] == document[length - 1:length - 1 + len(best)]
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (document[1:len(best)] != document[:len(best) - 1])])
    change = np.flatnonzero(new)
    many = np.add.reduceat(whole.astype(np.int64), change)  # the windows of one anchor in one document that are whole come first
    keep = many > 0
    return best[change[keep]], change[keep], change[keep] + many[keep] - 1
