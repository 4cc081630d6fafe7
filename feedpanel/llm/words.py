"""Words of many UTF-8 texts at once, as NumPy arrays.

A block is a run of rows whose texts lie behind one another in one byte array.
Word separators are ASCII bytes, so bytes can be classified without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_HASHED_WORDS = 1 << 18

_seeded = np.random.default_rng(20240501)
_BYTE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEAR = np.cumprod(np.full(4096, _BASE, np.uint64))
_FAR = np.cumprod(_NEAR[-1:].repeat(4096))

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a block: ``start`` and ``end`` bytes, ``first`` word of each row and of the end, 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        inside = ~separator[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        row_starts = offsets[:-1][offsets[:-1] < len(data)]
        begins[row_starts] = inside[row_starts]
        row_ends = offsets[1:][offsets[1:] > 0] - 1
        ends[row_ends] = inside[row_ends]
        self.data, self.separator = data, separator
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        values = np.where(self.separator, np.uint64(0), _BYTE)
        out = np.empty(len(self.start), np.uint64)
        for lo in range(0, len(out), _HASHED_WORDS):
            start, end = self.start[lo : lo + _HASHED_WORDS], self.end[lo : lo + _HASHED_WORDS]
            base = start[0]
            part = values[self.data[base : end[-1]]]
            begin = start - base
            place = np.arange(len(part)) - np.repeat(begin, np.diff(begin, append=len(part)))
            part *= _NEAR[place & 4095]
            if place.max() > 4095:
                part *= _FAR[(place >> 12) & 4095]
            out[lo : lo + _HASHED_WORDS] = np.add.reduceat(part, begin)
        return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words inside each row, and each row's first.

    A row with fewer words, but not none, has one shingle of all of them.
    """
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    begin = np.repeat(first[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(count, width), made)
    total = mix(length.astype(np.uint64))
    for k in range(width):
        there = length > k
        if there.all():
            total = mix(total * _BASE + hashes[begin + k])
        else:
            total[there] = mix(total[there] * _BASE + hashes[begin[there] + k])
    return total, offsets
