"""Periodic runs of words, found by probing a harmonic grid.

A run is a stretch of words with smallest period p (words p apart are equal), of at least max(LEAST,
TIMES * p) words, that can't be extended on either side.

* Grid: a run of four periods holds three neighbouring points jp at which the word equals the one at (j+1)p, so
  only the words at multiples of p are compared: n/p tests for each p, n log n in all. Short periods are probed on
  many texts at once; long periods of one text are probed point by point, for all periods at once.
* Survivors: three equal points in a row. They are thinned at further offsets and then extended to both
  sides by comparing slices that double in size. What lies in the extended stretch is skipped.
* Points within a run that was found for a divisor of p are skipped too: a stretch of period p that held p words
  of such a run would have its period.
* A stretch found before, with a smaller period, is that run. (By Fine and Wilf a smaller period of a stretch of
  four periods divides the larger one, so the stretch would have been found whole.)

Words are compared exactly, by their places in a dictionary of the texts probed together. Each text is
handled in one task on its own; nothing is shuffled.

Defined results: words are runs of other than white space, case kept. A null or empty text has no words, no
runs and an empty collapsed text. Repeated rows get equal results. Other columns are kept as they are; a
clashing one is refused with a message. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from affinia.llm.hashing import WHITE, chunks
from affinia.llm.tokens import words

#: Words and periods of a run at least.
LEAST, TIMES = 6, 4
#: Periods up to this are probed on many texts at once.
SHORT = 256
#: Survivors are thinned at so many offsets at most; extension starts with slices of so many words.
THIN, SLICE = 64, 64

RUN = "struct<start:long,length:long,period:long>"
ADDED = ("n_words", "runs", "collapsed")


def _right(w: np.ndarray, p: int, at: int) -> int:
    """The first place from at on whose word differs from the one p further."""
    size, end = SLICE, len(w) - p
    while at < end:
        stop = min(at + size, end)
        bad = np.flatnonzero(w[at:stop] != w[at + p : stop + p])
        if len(bad):
            return at + int(bad[0])
        at, size = stop, 2 * size
    return end


def _left(w: np.ndarray, p: int, at: int) -> int:
    """The first place of the stretch of equal words (p apart) that ends before at."""
    size = SLICE
    while at > 0:
        stop = max(0, at - size)
        bad = np.flatnonzero(w[stop:at] != w[stop + p : at + p])
        if len(bad):
            return stop + int(bad[-1]) + 1
        at, size = stop, 2 * size
    return 0


class Runs:
    """The runs of an array of words (numbers; a number that occurs once parts two texts)."""

    def __init__(self, w: np.ndarray):
        self.w = w
        self.found: dict[int, tuple[list[int], list[int]]] = {}
        self.seen: set[tuple[int, int]] = set()

    def probe(self, p: int, points: np.ndarray) -> None:
        """Extends the survivors of period p: points whose words equal those p, 2p and 3p further."""
        w = self.w
        for q, (starts, ends) in self.found.items():
            if p % q == 0 and len(points):
                k = np.searchsorted(starts, points, "right") - 1
                points = points[(k < 0) | (np.array(ends)[k] < points + p)]
        for t in range(1, min(2 * p, THIN)):
            if len(points) < 4:
                break
            points = points[w[points + t] == w[points + t + p]]
        done = -1
        for x in points.tolist():
            if x < done:
                continue
            done = _right(w, p, x)
            start, end = _left(w, p, x), done + p
            if end - start >= max(LEAST, TIMES * p) and (start, end) not in self.seen:
                self.seen.add((start, end))
                starts, ends = self.found.setdefault(p, ([], []))
                starts.append(start)
                ends.append(end)

    def short(self, most: int) -> None:
        """Probes the periods up to most, on the whole array."""
        for p in range(1, most + 1):
            grid = self.w[::p]
            same = grid[1:] == grid[:-1]
            points = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
            if len(points):
                self.probe(p, points * p)

    def long(self, least: int, base: int, n: int) -> None:
        """Probes the periods from least on, in the text of n words that starts at base: all periods at each point."""
        v = self.w[base : base + n]
        survivors, before = [], []
        for j in range(n // least):
            top = (n - 1) // (j + 1)
            count = top - least + 1
            if count <= 0:
                break
            same = v[j * least :: j][:count] == v[(j + 1) * least :: j + 1][:count] if j else v[0] == v[least : least + count]
            before.append(same)
            if j >= 2:
                three = before[0][:count] & before[1][:count] & same
                periods = np.flatnonzero(three) + least
                survivors.append(np.stack((periods, periods * (j - 2) + base)))
                before.pop(0)
        if survivors:
            periods, points = np.concatenate(survivors, axis=1)
            order = np.lexsort((points, periods))
            periods, points = periods[order], points[order]
            edges = np.concatenate((np.flatnonzero(np.diff(periods, prepend=-1)), [len(periods)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self.probe(int(periods[a]), points[a:b])

    def all(self) -> np.ndarray:
        """start, end, period of each run, by start and then period."""
        rows = [(s, e, p) for p, (starts, ends) in self.found.items() for s, e in zip(starts, ends, strict=True)]
        return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def find_runs(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the (start, end, period) of each run, in order. numbers: the words; first: each text's first word."""
    sizes = np.diff(first)
    base = first[:-1] + np.arange(len(sizes))
    w = np.empty(len(numbers) + len(sizes), np.int64)
    inside = np.ones(len(w), bool)
    inside[base + sizes] = False
    w[inside] = numbers
    w[~inside] = -1 - np.arange(len(sizes))
    most = int(sizes.max(initial=0)) // TIMES
    found = Runs(w)
    found.short(min(most, SHORT))
    rows = [found.all()]
    for k in np.flatnonzero(sizes >= TIMES * (SHORT + 1)).tolist():
        # The shorter periods of this text are known: they tell which stretches are runs already.
        own = Runs(w)
        a, b = int(base[k]), int(base[k] + sizes[k])
        for s, e, p in rows[0][(rows[0][:, 0] >= a) & (rows[0][:, 0] < b)].tolist():
            own.seen.add((s, e))
            starts, ends = own.found.setdefault(p, ([], []))
            starts.append(s)
            ends.append(e)
        own.long(SHORT + 1, a, b - a)
        more = own.all()
        rows.append(more[more[:, 2] > SHORT])
    runs = np.concatenate(rows)
    text = np.searchsorted(base, runs[:, 0], "right") - 1
    runs[:, :2] -= base[text][:, None]
    order = np.lexsort((runs[:, 2], runs[:, 0], text))
    return text[order], runs[order]


def _kept(first: np.ndarray, text: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    n = int(first[-1])
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, first[text] + runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, first[text] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def _collapsed(found: pa.Array, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The words that stay, joined by one blank, for each text."""
    offsets = np.concatenate(([0], np.cumsum(kept)))[first]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), found.filter(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed: the text without what repeats."""
    if clash := [c for c in ADDED if c in docs.columns]:
        raise ValueError(f"docs already has {', '.join(clash)}")
    others = [c for c in docs.columns if c != text_col]
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(at)):
                found, first = words(data, ~WHITE[data], offsets)
                numbers = found.dictionary_encode().indices.to_numpy()
                text, runs = find_runs(numbers, first)
                lists = np.searchsorted(text, np.arange(len(first)))
                start, end, period = (pa.array(c) for c in runs.T.copy())
                items = pa.StructArray.from_arrays([start, pc.subtract(end, start), period], ["start", "length", "period"])
                columns = [c.slice(row, len(first) - 1) for c in batch.columns[:at]]
                columns += [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), items)]
                yield pa.record_batch([*columns, _collapsed(found, first, _kept(first, text, runs)).cast(pa.string())], [*others, *ADDED])

    kept = ", ".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in others)
    schema = f"{kept}{', ' if kept else ''}n_words long, runs array<{RUN}>, collapsed string"
    return docs.select(*[f"`{c.replace('`', '``')}`" for c in others], text_col).mapInArrow(run, schema)
