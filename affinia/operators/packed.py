"""Sets of numbers as bytes: the gaps between them in groups of 7 bits, or a map of bits where that is shorter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Rows that a task packs at once, and bytes of sets that it unpacks at once.
ROWS, BYTES = 1 << 22, 1 << 20


def pack(numbers: np.ndarray, heads: np.ndarray) -> list[bytes]:
    """The sets that start at heads, each with its numbers (below 2^31) in ascending order."""
    if not len(heads):
        return []
    before = np.concatenate(([-1], numbers[:-1]))
    before[heads] = -1
    gaps = numbers - before - 1
    wide = 1 + sum((gaps >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    ends = np.cumsum(wide)
    at = np.repeat(np.arange(len(gaps)), wide)
    k = np.arange(ends[-1]) - (ends - wide)[at]
    data = (((gaps[at] >> 7 * k) & 127) | ((k < wide[at] - 1) << 7)).astype(np.uint8).tobytes()
    tails = np.append(heads[1:], len(numbers))
    low, high = (ends - wide)[heads], ends[tails - 1]
    out = [b"\1" + data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    size = numbers[tails - 1] // 8 + 1
    for r in np.flatnonzero(size < high - low):
        bits = np.zeros(size[r] * 8, np.uint8)
        bits[numbers[heads[r] : tails[r]]] = 1
        out[r] = b"\0" + np.packbits(bits).tobytes()
    return out


def unpack(sets: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all sets, one after the other, and the size of each set."""
    gaps = [r for r in sets if r[0]]
    numbers, sizes = _from_gaps(gaps) if gaps else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(gaps) == len(sets):
        return numbers, sizes
    listed = iter(np.split(numbers, np.cumsum(sizes)[:-1]))
    parts = [next(listed) if r[0] else np.flatnonzero(np.unpackbits(np.frombuffer(r, np.uint8, offset=1))) for r in sets]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _from_gaps(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(r[1:] for r in sets), np.uint8)
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    k = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    steps = np.add.reduceat((data & 127).astype(np.int64) << 7 * k, starts) + 1
    sizes = np.diff(np.cumsum(last)[np.cumsum([len(r) - 1 for r in sets]) - 1], prepend=0)
    heads = np.cumsum(sizes) - sizes
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[heads] - steps[heads], sizes) - 1, sizes


def gathered(rows: DataFrame, key: str, number: str, packed: str) -> DataFrame:
    """key, packed: the set of each key's numbers (int). Tasks pack what they read, ROWS at a time, before the shuffle."""
    kind = StructType([rows.schema[key], StructField(packed, BinaryType())])

    def piece(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = pa.concat_arrays([b.column(0) for b in held]).dictionary_encode("encode")
        numbers = pa.concat_arrays([b.column(1) for b in held]).to_numpy()
        code, heads, sets = _sets(keys.indices.to_numpy(), numbers)
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[heads])), pa.array(sets, pa.binary())], names=[key, packed])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield piece(held)
                held = []
        if sum(b.num_rows for b in held):
            yield piece(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy()
            for low, high in _slices(np.add.reduceat(_lengths(batch.column(1).flatten()), np.cumsum(counts) - counts) if len(counts) else counts):
                some = batch.column(1).slice(low, high - low)
                numbers, sizes = unpack(some.flatten().to_pylist())
                _, _, sets = _sets(np.repeat(np.repeat(np.arange(high - low), counts[low:high]), sizes), numbers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets, pa.binary())], names=[key, packed])

    parts = rows.select(key, number).mapInArrow(pieces, kind)
    return parts.groupBy(key).agg(F.collect_list(packed).alias(packed)).mapInArrow(merged, kind)


def counted(sets: DataFrame, key: str, packed: str) -> DataFrame:
    """key (long), number, count: in how many of a key's sets a number is."""
    kind = StructType([StructField(c, LongType()) for c in (key, "number", "count")])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for low, high in _slices(_lengths(batch.column(1))):
                numbers, sizes = unpack(batch.column(1).slice(low, high - low).to_pylist())
                both = np.sort(np.repeat(keys[low:high], sizes) << 32 | numbers)
                heads = np.flatnonzero(np.diff(both, prepend=-1))
                n = np.diff(np.append(heads, len(both)))
                yield pa.RecordBatch.from_arrays([pa.array(both[heads] >> 32), pa.array(both[heads] & 0xFFFFFFFF), pa.array(n)], names=kind.names)

    return sets.select(F.col(key).cast("long"), packed).mapInArrow(counts, kind).groupBy(key, "number").agg(F.sum("count").alias("count"))


def _sets(code: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The codes in order, where each starts, and the packed set of each."""
    both = np.sort(code.astype(np.int64) << 32 | numbers)
    both = both[np.diff(both, prepend=-1) > 0]
    code = both >> 32
    heads = np.flatnonzero(np.diff(code, prepend=-1))
    return code, heads, pack(both & 0xFFFFFFFF, heads)


def _lengths(sets: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about BYTES bytes, one row at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // BYTES, prepend=-1)).tolist()
    yield from zip(cuts, [*cuts[1:], len(lengths)], strict=False)
