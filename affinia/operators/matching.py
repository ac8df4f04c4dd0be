"""Joins beyond equality: nearest in time, greedy one-to-one, resolution by priority, names."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.ranking import first_per_group

WINDOW_S = 900
#: Rows of a group of stretches.
PER_GROUP = 20_000


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], window: int = WINDOW_S) -> DataFrame:
    """left_id, right_id, delta: the nearest right row within the window, the earlier on ties.

    left: left_id, t, keys; right: right_id, t, keys (t in seconds). Times are cut into windows, and a
    left row looks into its own and both neighbours, so that it meets only rows that can match.
    """
    slot = lambda c: F.floor(F.col(c) / window)
    near = left.withColumn("__slot", F.explode(F.array(slot("t") - 1, slot("t"), slot("t") + 1)))
    other = right.withColumnRenamed("t", "__t").withColumn("__slot", slot("__t"))
    met = near.join(other, [*keys, "__slot"]).withColumn("delta", F.abs(F.col("__t") - F.col("t"))).where(F.col("delta") <= window)
    return first_per_group(met, ["left_id"], [F.asc("delta"), F.asc("__t"), F.asc("right_id")]).select("left_id", "right_id", "delta")


def greedy_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], window: int = WINDOW_S, per_group: int = PER_GROUP) -> DataFrame:
    """As nearest_in_time, but one to one: left rows in order of their id claim the nearest row still free.

    A key's rows are cut where more than the window passes without any: no match reaches across. Each such
    stretch with rows on both sides is solved on its own; stretches are dealt to groups of about per_group rows.
    """
    a = left.select(*keys, F.col("left_id").alias("id"), "t", F.lit(0).alias("side"))
    b = right.select(*keys, F.col("right_id").alias("id"), "t", F.lit(1).alias("side"))

    def claim(lefts: list[tuple], free: list[tuple]) -> Iterator[tuple]:
        free.sort()
        for id_, t in sorted(lefts):
            at = bisect_left(free, (t,))
            near = [i for i in (bisect_left(free, (free[at - 1][0],)) if at else -1, at) if 0 <= i < len(free)]
            best = min(near, key=lambda i: (abs(free[i][0] - t), free[i]), default=None)
            if best is not None and abs(free[best][0] - t) <= window:
                u, other = free.pop(best)
                yield id_, other, abs(u - t)

    def claims(pdf: pd.DataFrame) -> pd.DataFrame:
        stretch = pdf.groupby([*keys, "__part"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(stretch, kind="stable")
        id_, t, side = (pdf[c].to_numpy()[order].tolist() for c in ("id", "t", "side"))
        cuts = [*np.flatnonzero(np.diff(stretch[order], prepend=-1)).tolist(), len(order)]
        out = []
        for low, high in zip(cuts, cuts[1:]):
            lefts = [(id_[k], t[k]) for k in range(low, high) if side[k] == 0]
            if 0 < len(lefts) < high - low:
                out += claim(lefts, [(t[k], id_[k]) for k in range(low, high) if side[k] == 1])
        return pd.DataFrame(out, columns=["left_id", "right_id", "delta"]).astype("int64")

    by_time = Window.partitionBy(*keys).orderBy("t", "side", "id")
    gap = F.coalesce((F.col("t") - F.lag("t").over(by_time) > window).cast("int"), F.lit(0))
    both = a.unionByName(b)
    groups = F.lit(max(1, both.count() // per_group))
    parts = both.withColumn("__gap", gap).withColumn("__part", F.sum("__gap").over(by_time)).drop("__gap")
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64(*keys, "__part"), groups))
    return dealt.groupBy("__group").applyInPandas(claims, "left_id long, right_id long, delta long")


def resolved(entries: DataFrame, ids: DataFrame, priority: Sequence[str]) -> DataFrame:
    """entry, kind, item: the item of the first namespace that has one within the kind. entries: entry, kind, namespace, value."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("namespace"))
    hits = entries.join(ids, ["namespace", "value", "kind"]).withColumn("__order", order).where("__order > 0")
    return hits.groupBy("entry", "kind").agg(F.min_by("item", F.struct("__order", "item")).alias("item"))


def either_end(edges: DataFrame, node) -> DataFrame:
    """other and the edge's columns, for edges that touch a node at either end: two filters instead of an OR."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    out = edges.where(F.col("a") == node).select(F.col("b").alias("other"), *rest)
    return out.unionByName(edges.where((F.col("b") == node) & (F.col("a") != node)).select(F.col("a").alias("other"), *rest))


def named_alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, name: accounts of two systems with the same name (id 0 left out), and those of one only."""
    a = left.where("id <> 0").select(F.col("id").alias("left_id"), "name")
    b = right.where("id <> 0").select(F.col("id").alias("right_id"), "name")
    return a.join(b, "name", "full")
