"""Words, shingles and hashes of whole columns of text, as numpy arrays over the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; arrays of eight bytes for each stay in the cache.
BLOCK = 1 << 16

#: The bytes that separate words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower case for A to Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64; changes and returns ``x``, which has to be uint64."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, start: int = 0) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(start)) * U(0x9E3779B97F4A7C15))


_PLACE = seeds(64, 3000) | U(1)
_EIGHTS = seeds(64, 4000)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK`` bytes that no word crosses."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + BLOCK, n)
        while to < n:
            i = np.searchsorted(offsets, to)
            if i < len(offsets) and offsets[i] == to:
                break
            stop = min(to + 4096, n, int(offsets[i]))
            gap = SPACE[data[to:stop]]
            if gap.any():
                to += int(gap.argmax())
                break
            to = stop
        yield at, to
        at = to


def _starts(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For a range: which bytes belong to words, and at which of them a word starts."""
    inside = ~SPACE[data[at:to]]
    edge = np.ones(to - at + 1, bool)
    np.logical_not(inside[:-1], out=edge[1 : to - at])
    own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
    edge[own] = True
    return inside, inside & edge[: to - at]


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each value."""
    found = [np.zeros(0, np.int64)]
    for at, to in _cuts(data, offsets):
        found.append(np.flatnonzero(_starts(data, offsets, at, to)[1]) + at)
    return np.diff(np.searchsorted(np.concatenate(found), offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and the n + 1 offsets of the values among them.

    Each eight bytes of a word are mixed with their place in it before they are added up.
    """
    hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for at, to in _cuts(data, offsets):
        inside, start = _starts(data, offsets, at, to)
        first = np.flatnonzero(start)
        if not len(first):
            continue
        places.append(first + at)
        first = np.flatnonzero(start[inside])
        letters = LOWER[data[at:to][inside]]
        lengths = np.diff(first, append=len(letters))
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        eighth = place & 7
        start = np.flatnonzero(eighth == 0)
        eights = np.add.reduceat(letters.astype(U) << (eighth << 3).astype(U), start)
        eights ^= _EIGHTS[np.minimum(place[start] >> 3, len(_EIGHTS) - 1)]
        far = place[start] >> 3 >= len(_EIGHTS)
        if far.any():
            eights[far] ^= mix((place[start][far] >> 3).astype(U))
        mix(eights)
        hashes.append(mix(np.add.reduceat(eights, np.searchsorted(start, first)) + lengths.astype(U)))
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words in order, repeats included, and their offsets by value.

    A value of fewer words has its whole sequence as one; without words it has none.
    """
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    total = len(hashes)
    full = np.zeros(total, U)
    length = np.repeat(n, n)
    left = np.repeat(offsets[1:], n) - np.arange(total)
    for j in range(k):
        if j < total:
            part = hashes[j:] * _PLACE[j]
            if (n < k).any():
                part[left[: total - j] <= j] = 0
            full[: total - j] += part
    full += np.minimum(length, k).astype(U) * _PLACE[k]
    mix(full)
    inner = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], count)
    return full[np.repeat(offsets[:-1], count) + inner], out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's different values in ascending order, and the offsets of the groups."""
    parts, counts = [np.zeros(0, values.dtype)], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            x = np.sort(values[a:b])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
            parts.append(x)
            counts[i] = len(x)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values with at most ``most`` entries in all, or of one value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
