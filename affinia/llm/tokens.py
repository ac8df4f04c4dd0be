"""The words of many texts at once, as Arrow arrays, for tasks that need the words themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside, and each text's first run (with the count at the end).

    at: the offsets of the texts; a run doesn't go on from one text to the next.
    """
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    start[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


def words(data: np.ndarray, inside: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words (bytes) of the texts, one after the other, and each text's first (with the count at the end)."""
    starts, ends, first = spans(inside, at)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    packed = pa.py_buffer(np.ascontiguousarray(data[inside]))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), packed]), first


def spaced(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one blank after each, and where each word starts there (with the whole length at the end)."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int64)
    out = np.full(int(offsets[-1]), 32, np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[inside]
    return out.tobytes(), offsets
