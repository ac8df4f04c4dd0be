"""Sums that are equal to the last bit for any partitioning, and draws that follow a stated stream of numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from affinia.operators.layout import STEP, split_mix
from affinia.operators.ranking import placed_in_group
from affinia.operators.shared import stored

#: The pairwise rule: up to BLOCK numbers are added in LANES running sums, more are halved at a multiple of LANES.
LANES, BLOCK = 8, 128
#: Rows of a draw that are looked at together.
DRAWN = 1 << 16


def pairwise_sums(rows: np.ndarray) -> np.ndarray:
    """The sum of each row, in the number's own width, by the pairwise rule; all rows take the same steps."""
    n = rows.shape[1]
    if n < LANES:
        out = np.zeros(len(rows), rows.dtype)
        for k in range(n):
            out = out + rows[:, k]
        return out
    if n > BLOCK:
        half = n // 2 - n // 2 % LANES
        return pairwise_sums(rows[:, :half]) + pairwise_sums(rows[:, half:])
    whole = n - n % LANES
    lanes = rows[:, :LANES].copy()
    for k in range(LANES, whole, LANES):
        lanes += rows[:, k : k + LANES]
    while lanes.shape[1] > 1:
        lanes = lanes[:, ::2] + lanes[:, 1::2]
    out = lanes[:, 0]
    for k in range(whole, n):
        out = out + rows[:, k]
    return out


@F.pandas_udf(FloatType())
def pairwise_norm(vector: pd.Series) -> pd.Series:
    """The length of each vector, in 32 bits; null for null, vectors may differ in width."""
    out = pd.Series([None] * len(vector), index=vector.index, dtype="Float32")
    known = vector.dropna()
    widths = known.map(len)
    for width in widths.unique():
        some = known[widths == width]
        rows = np.stack([np.asarray(v, np.float32) for v in some]).reshape(len(some), int(width))
        out[some.index] = np.sqrt(pairwise_sums(rows * rows))
    return out


def tree_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str = "total") -> DataFrame:
    """by, total: the sum of each group's values in double. The rows' order alone says which are added first, so that
    partitioning, retries and the number of tasks change no bit.

    BLOCK neighbours are added one after the other, then BLOCK of those sums, and so on: a group of any size takes
    a few shuffles, each smaller by BLOCK. Nulls count for nothing; a group of nulls has no row.
    """
    placed = placed_in_group(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), *[c.alias(f"__o{k}") for k, c in enumerate(order)]), list(by), [F.col(f"__o{k}") for k in range(len(order))], "__at", "__size")
    left = placed.agg(F.max("__size")).first()[0] or 0
    level = placed.select(*by, "__at", "__v")
    while True:
        leaves = level.groupBy(*by, F.floor(F.col("__at") / BLOCK).alias("__up")).agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__x"))  # BLOCK numbers
        level = leaves.select(*by, F.col("__up").alias("__at"), F.aggregate("__x", F.lit(0.0), lambda a, x: a + x["__v"]).alias("__v"))
        left = -(-left // BLOCK)
        if left <= 1:
            return level.select(*by, F.col("__v").alias(name))
        level = stored(level, "level")


class Stream:
    """Numbers from 0 to 1 (without it) that depend on the seed alone: SplitMix64's upper 53 bits."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def unit(self) -> float:
        self.state = (self.state + STEP) & 0xFFFFFFFFFFFFFFFF
        return int(split_mix(np.array([self.state], np.uint64))[0] >> np.uint64(11)) / float(1 << 53)


def _picked(weights_of, totals: np.ndarray, n: int, rows: int, stream: Stream) -> list[int]:
    """The places of n picks: each takes the first row at which the running sum exceeds a number below the whole."""
    taken: list[int] = []
    seen: dict[int, np.ndarray] = {}
    for _ in range(min(n, rows)):
        whole = float(np.cumsum(totals)[-1])
        if whole > 0:
            target, before = stream.unit() * whole, np.concatenate(([0.0], np.cumsum(totals)))
            full = np.flatnonzero(totals > 0)
            over = full[before[full + 1] > target]
            k = int(over[0] if len(over) else full[-1])
            if k not in seen:
                seen[k] = weights_of(k)
            w = seen[k]
            running = np.cumsum(np.concatenate(([before[k]], w)))[1:]
            good = np.flatnonzero((w > 0) & (running > target))
            at = int(good[0] if len(good) else np.flatnonzero(w > 0)[-1])
            w[at] = 0.0
            totals[k] = float(np.cumsum(w)[-1])
            taken.append(k * DRAWN + at)
        else:
            taken.append(next(i for i in range(rows) if i not in taken))
    return taken


def sequential_draw(scored: DataFrame, n: int, seed: int, order: Sequence[Column], probability: str = "probability") -> DataFrame:
    """n rows in the order in which they are picked (pick, from 1), without replacement, with chances of a column.

    Rows stand in the stated order. Each pick takes one number of the seed's stream times what is left, and the
    row at which the running sum of what is left exceeds it; once nothing is left the first rows follow. If a
    chance is null, the first n rows are taken. The driver holds the sums of blocks of DRAWN rows, and the
    chances of the blocks that were picked from: n at most.
    """
    spark = scored.sparkSession
    # Chances have 32 bits, and are added up in 64.
    placed = stored(placed_in_group(scored.withColumn("__p", F.col(probability).cast("float").cast("double")), [], list(order), "__at", "__size"), "placed")
    block = F.floor(F.col("__at") / DRAWN)
    rows, unknown = placed.agg(F.count(F.lit(1)), F.count_if(F.col("__p").isNull())).first()
    if unknown or not rows:
        places = list(range(min(n, rows)))
    else:

        def weights_of(k: int) -> np.ndarray:
            return np.array([r["__p"] for r in placed.where(block == k).orderBy("__at").select("__p").collect()])

        if rows <= DRAWN:
            first = weights_of(0)
            totals = np.array([float(np.cumsum(first)[-1])])
        else:
            totals = np.array([r["s"] for r in placed.groupBy(block.alias("k")).agg(F.sum("__p").alias("s")).orderBy("k").collect()])
        places = _picked(weights_of, totals, n, rows, Stream(seed))
    picks = F.broadcast(spark.createDataFrame([(p, k + 1) for k, p in enumerate(places)], "__at long, pick int"))  # n rows
    return placed.join(picks, "__at").drop("__at", "__size", "__p")

