"""Products of all pairs in blocks: which groups of blocks there are, and the best of each row within one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products that a task holds at once, and columns that a row's least product is taken from.
CELLS, HEAD = 1 << 22, 1024


def paired(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (with a block) once for each pair of blocks i <= j that its own is in."""
    grid = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return grid.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o")


def best(products: Callable[[int, int], np.ndarray], ids: np.ndarray, others: np.ndarray, top: int, least: float, bars: np.ndarray | None = None, slack: float = 0.0, exact: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ids, places in others, products: the top others of each id, rounded to six digits, of least or more.

    products(low, high) has a row for each of ids[low:high] and a column for each of others, which ascend, so that
    the first of equal ones stay. A row never meets its own id. bars, if given, are a known least cosine for each
    row's answer, which then isn't looked for here. Where products are near ones only, off by slack of a bar at most,
    exact(rows, columns) gives those that may be in an answer.
    """
    wide = len(others)
    step = max(1, CELLS // max(wide, 1))
    for low in range(0, len(ids) if wide else 0, step):
        c = products(low, min(low + step, len(ids)))
        mine = ids[low : low + step]
        first, last = np.searchsorted(others, mine, "left"), np.searchsorted(others, mine, "right")
        for k in np.flatnonzero(last > first):
            c[k, first[k] : last[k]] = -np.inf
        bar = np.full(len(mine), least - 5.01e-7)
        if bars is not None:
            bar = np.maximum(bar, bars[low : low + step] - 1e-6)
        elif wide > top:
            head = c[:, : max(HEAD, top)]
            bar = np.maximum(bar, np.partition(head, head.shape[1] - top, axis=1)[:, head.shape[1] - top] - 1e-6)
        bar = bar if exact is None else (bar * (1 - slack)).astype(c.dtype)
        i, j = np.nonzero(c >= bar[:, None])
        v = np.round(c[i, j] if exact is None else exact(i + low, j), 6)
        i, j, v = i[v >= least], j[v >= least], v[v >= least]
        order = np.lexsort((j, -v, i))
        i, j, v = i[order], j[order], v[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < top
        yield i[kept] + low, j[kept], v[kept]
