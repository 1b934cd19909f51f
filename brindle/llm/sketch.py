"""Fast similarity sketching of sets.

Each of up to 2t rounds hashes every element of a set. In the first t rounds an element falls into
a bin and leaves a value there; in the last t rounds every element falls into the one bin that has
the round's number, so that every bin is filled in the end. A bin keeps the least value of the first
round that reached it. A set that has t ln t elements or more fills nearly all bins in the first
round, a small one takes more rounds over few elements, so the work is O(n + t log t) as expected.
Two sets agree in a bin with a chance equal to their Jaccard similarity, and the count of bins that
agree is concentrated as if bins were independent (Dahlgaard, Knudsen and Thorup, 2017).
"""

from __future__ import annotations

import numpy as np

from brindle.llm.text import U, mix, seeds

_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int, seed: int = 0) -> np.ndarray:
    """An n x t array of 32-bit coordinates for n sets of hashed elements; empty sets have zeros.

    t has to be a power of two.
    """
    if t & (t - 1):
        raise ValueError("t has to be a power of two")
    n = len(offsets) - 1
    out = np.full((n, t), _EMPTY, U)
    count = np.diff(offsets)
    rows = np.flatnonzero(count)  # sets that still have empty bins
    keys = seeds(2 * t, 10_000 + 4 * t * seed)
    el, owner = elements, np.repeat(np.arange(len(rows)), count[rows])
    for i in range(2 * t):
        if not len(rows):
            break
        h = mix(el ^ keys[i])
        at = owner * t + ((h & U(t - 1)).astype(np.int64) if i < t else i - t)
        least = np.full(len(rows) * t, _EMPTY, U)
        np.minimum.at(least, at, h >> U(8))
        least = least.reshape(-1, t)
        have = out[rows]
        new = (have == _EMPTY) & (least != _EMPTY)
        have[new] = mix(least[new] * U(2) + keys[i]) >> U(32)
        out[rows] = have
        still = (have == _EMPTY).any(axis=1)
        if not still.all():
            keep = still[owner]
            el = el[keep]
            owner = (np.cumsum(still) - 1)[owner[keep]]
            rows = rows[still]
    out[count == 0] = 0
    return out.astype(np.uint32)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """An n x (t / rows) array of 64-bit keys; sets share one if a whole band agrees."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows).astype(U)
    key = np.broadcast_to(seeds(t // rows, 77_000), (n, t // rows)).copy()
    for r in range(rows):
        key ^= parts[:, :, r] * U(2 * r + 0x9E3779B1)
        mix(key)
    return key.view(np.int64)


def low_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate, packed into 64-bit numbers."""
    return np.packbits((sketch & 1).astype(np.uint8), axis=1).view(np.int64)
