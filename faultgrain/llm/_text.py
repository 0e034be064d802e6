"""Vectorised text helpers for Arrow batches.

A batch's string column is one UTF-8 buffer plus offsets, so words and
shingles of all its rows are hashed together with a few numpy passes and no
Python loop over words. Rows are taken in slices of bounded size, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class Words(NamedTuple):
    """Hashes of all words of some rows; ``ends[i]`` is where row i's stop."""

    hashes: np.ndarray
    ends: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _lower_table()[data]


@lru_cache(1)
def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(1)
def _space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), _MULTIPLIER, dtype=np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors)
    return _powers[:n]


@lru_cache(1)
def _inverse_steps() -> tuple[np.ndarray, np.ndarray]:
    low = np.full(4096, _INVERSE, dtype=np.uint64)
    low[0] = 1
    low = np.cumprod(low)
    high = np.full(1 << 16, pow(_INVERSE, 4096, 1 << 64), dtype=np.uint64)
    high[0] = 1
    return low, np.cumprod(high)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, ends) for runs of whole rows.

    A run holds about ``limit`` bytes; a longer row makes a run of its own.
    Null rows count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row + 1 : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> Words:
    """Hash the words ``[^\\x20\\x09-\\x0D]+`` of rows that end at ``ends``."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    inside = ~_space_table()[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = ends[ends < n]
    edges = edges[edges > 0]
    starts[edges] |= inside[edges]
    stops[edges - 1] |= inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    if not len(first):
        return Words(np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    codes = _byte_codes()[_lower_table()] if lower else _byte_codes()
    sums = np.cumsum(codes[data] * _powers_to(n))
    hashes = sums[last]
    hashes[1:] -= np.where(first[1:] > 0, sums[first[1:] - 1], np.uint64(0))
    if first[0] > 0:
        hashes[0] -= sums[first[0] - 1]
    low, high = _inverse_steps()
    hashes = hashes * low[first & 4095] * high[first >> 12]
    return Words(mix(hashes + (last - first).astype(np.uint64)), np.searchsorted(first, ends))


def shingles(found: Words, size: int, whole_if_short: bool) -> Words:
    """Hash runs of ``size`` words within each row, in order, repeats kept.

    A row with fewer words (but at least one) gives its whole sequence as one
    shingle if ``whole_if_short``, else none.
    """
    hashes, ends = found
    starts = np.concatenate([[0], ends[:-1]])
    counts = ends - starts
    n = len(hashes) - size + 1
    if n > 0:
        rolled = mix(hashes[:n] + np.uint64(size))
        for k in range(1, size):
            rolled = mix(rolled * np.uint64(0xA24BAED4963EE407) + hashes[k : k + n])
        row_of = np.repeat(np.arange(len(ends)), counts)
        fits = row_of[:n] == row_of[size - 1 :]
        rolled = rolled[fits]
        per_row = np.maximum(counts - size + 1, 0)
    else:
        rolled, per_row = np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size)) if whole_if_short else []
    if len(short):
        extra = []
        for i in short:
            value = mix(np.array([counts[i]], dtype=np.uint64))
            for h in hashes[starts[i] : ends[i]]:
                value = mix(value * np.uint64(0xA24BAED4963EE407) + h)
            extra.append(value[0])
        before = np.cumsum(per_row)
        rolled = np.insert(rolled, before[short], np.array(extra, dtype=np.uint64))
        per_row = per_row.copy()
        per_row[short] = 1
    return Words(rolled, np.cumsum(per_row))


def distinct(found: Words) -> Words:
    """Sorted distinct hashes of each row."""
    hashes, ends = found
    starts = np.concatenate([[0], ends[:-1]])
    parts, sizes = [], np.zeros(len(ends), np.int64)
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if b > a:
            part = np.sort(hashes[a:b])
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            parts.append(part)
            sizes[i] = len(part)
    return Words(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes))


def longs(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return hashes.view(np.int64)
