"""Numpy kernels over Arrow string columns: words, shingle hashes and byte windows.

All kernels work on the UTF-8 bytes of a whole Arrow batch at once. A null text counts as empty.
Hashes are 64-bit: a polynomial modulo 2**64 for each word, mixed, then chained over the words of a
shingle, so texts never become Python objects on the hot path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        out = np.full(size, BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column and where each text starts (one offset more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's bounds."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    starts[inner] |= mask[inner]
    ends[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span data[start:end]; equal spans have equal hashes wherever they stand."""
    length = ends - starts
    sums = np.zeros(len(starts), np.uint64)
    index = np.flatnonzero(length <= 64)
    if len(index):
        index = index[np.argsort((64 - length[index]).astype(np.uint8), kind="stable")]
        start, left, out = starts[index], -length[index], np.zeros(len(index), np.uint64)
        for i in range(-int(left[0])):
            live = int(np.searchsorted(left, -i, side="left"))
            out[:live] = out[:live] * BASE + (data[start[:live] + i].astype(np.uint64) + U64(1))
        sums[index] = out
    for i in np.flatnonzero(length > 64):
        sums[i] = ((data[starts[i] : ends[i]].astype(np.uint64) + U64(1)) * powers(int(length[i]))[::-1]).sum(dtype=np.uint64)
    return mix(sums + length.astype(np.uint64) * MIX_2)


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word (one entry more than texts).

    A word is a maximal run of bytes that are not SPACE, or of bytes marked in is_word.
    """
    starts, ends = runs(~SPACE[data] if is_word is None else is_word[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds, side="left")


def chained(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width values, over the whole array."""
    n = len(values) - width + 1
    out = np.full(max(n, 0), U64(width), np.uint64)
    for i in range(width if n > 0 else 0):
        out = mix(out * BASE + values[i : i + n])
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and where each text's shingles start.

    A text of fewer than width words has one shingle, its whole sequence; a text without words has none.
    """
    count = np.diff(first)
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], np.uint64)
    every = chained(hashes, width)
    long = count >= width
    if long.any():
        which = ragged(first[:-1][long], sizes[long])
        out[ragged(bounds[:-1][long], sizes[long])] = every[which]
    for i in np.flatnonzero((count > 0) & ~long):
        own = hashes[first[i] : first[i + 1]]
        out[bounds[i]] = chained(own, len(own))[0]
    return out, bounds


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start+1, .. of the given sizes."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's distinct values in ascending order, and the new bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner)) if len(values) else np.zeros(0, np.int64)
    values = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[fresh], minlength=len(bounds) - 1) if len(values) else np.zeros(len(bounds) - 1, np.int64)
    return values[fresh], np.concatenate([[0], np.cumsum(sizes)])


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes that start at each byte but the last width-1."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # doubling: hashes of 1, 2, 4, .. bytes, joined by the bits of width
    part, size, out, done = data.astype(np.uint64) + U64(1), 1, np.zeros(n, np.uint64), 0
    power = powers(width + 1)
    while size <= width:
        if width & size:
            out = out * power[size] + part[done : done + n]
            done += size
        if 2 * size <= width:
            part = part[: len(part) - size] * power[size] + part[size:]
        size *= 2
    return mix(out)


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places of values that are the minimum of some window of width neighbours; fewer values are one window."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= width:
        return np.flatnonzero(values == values.min())
    low, size = values, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n - width + 1], low[width - size : width - size + n - width + 1])
    # a value is a minimum of a window if it equals the least window minimum around it, the largest of those
    high, size = low, 1
    pad = np.zeros(width - 1, np.uint64)
    high = np.concatenate([pad, low, pad])
    while 2 * size <= width:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    if size < width:
        high = np.maximum(high[:n], high[width - size : width - size + n])
    return np.flatnonzero(values == high[:n])


INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_inverses = np.ones(1, dtype=np.uint64)


def range_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of data[low:high] for many ranges of one text, from its prefix sums; equal bytes, equal hash."""
    global _inverses
    n = len(data)
    if len(_inverses) <= n:
        out = np.full(max(n + 1, 1 << 16, 2 * len(_inverses)), INVERSE, np.uint64)
        out[0] = 1
        _inverses = np.multiply.accumulate(out)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers(n), out=total[1:])
    return mix((total[high] - total[low]) * _inverses[low] + (high - low).astype(np.uint64) * MIX_2)
