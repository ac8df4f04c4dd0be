"""Vectorised hashing of the words of many texts at once, for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A number for each byte; white space counts as nothing.
VALUE = np.where(WHITE, U(0), mix(np.arange(1, 257, dtype=U)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, most: int = CHUNK, rows: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that have about most bytes together, and at most so many rows."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = end if rows is None else min(end, row + rows)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's first word (with the count of words at the end)."""
    inside = ~WHITE[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; it depends on the word's bytes alone."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data))
    sums = np.add.reduceat(VALUE[data] * up[: len(data)], starts)
    return mix(sums * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words, lower-cased (A-Z only).

    A text with fewer words has its whole sequence as one shingle; without words it has none.
    """
    odd = [U(((2 * k + 1) * 0xA0761D6478BD642F | 1) & 0xFFFFFFFFFFFFFFFF) for k in range(width)]
    for _, data, at in chunks(column):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, at)
        h = word_hashes(data, starts, ends)
        n = len(h) - width + 1
        wide = np.zeros(max(n, 0), U)
        for k in range(width):
            wide += h[k : k + max(n, 0)] * odd[k]
        wide = mix(wide + U(width))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                one = np.sort(wide[a : b - width + 1])
                yield one[np.concatenate(([True], one[1:] != one[:-1]))]
            elif b > a:
                some = h[a:b] * np.array(odd[: b - a], U)
                yield mix(some.sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)
