"""Shots and samples on a timeline of cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_GAP_MS, STEP_MS = 500, 2000


def kept_cuts(cuts: Column, duration: Column, gap: int = MIN_GAP_MS) -> Column:
    """0, the cuts that are far enough behind the last one kept and before the end, and the duration."""

    def keep(acc: Column, t: Column) -> Column:
        far = (t - F.element_at(acc, -1) >= gap) & (t < duration)
        return F.when(far, F.concat(acc, F.array(t))).otherwise(acc)

    start = F.array(F.lit(0).cast("long"))
    return F.concat(F.aggregate(F.array_sort(cuts), start, keep), F.array(duration))


def shots(titles: DataFrame, gap: int = MIN_GAP_MS) -> DataFrame:
    """item, shot, start_ms, end_ms. titles: item, cuts (array of long), duration_ms."""
    edges = titles.select("item", kept_cuts(F.col("cuts"), F.col("duration_ms"), gap).alias("edges"))
    pair = F.transform(F.slice("edges", F.lit(1), F.size("edges") - 1), lambda s, i: F.struct(s.alias("start_ms"), F.get("edges", i + 1).alias("end_ms")))
    return edges.select("item", F.posexplode(pair).alias("shot", "x")).select("item", F.col("shot").cast("long").alias("shot"), "x.*")


def samples(shots_: DataFrame, step: int = STEP_MS) -> DataFrame:
    """item, shot, t_ms: the middle of a short shot, else every step from half a step on."""
    length = F.col("end_ms") - F.col("start_ms")
    middle = F.array(F.col("start_ms") + F.floor(length / 2))
    half = step // 2
    many = F.sequence(F.col("start_ms") + half, F.greatest(F.col("end_ms") - 1, F.col("start_ms") + half), F.lit(step).cast("long"))
    return shots_.select("item", "shot", F.explode(F.when(length <= step, middle).otherwise(many)).alias("t_ms"))


def islands(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """by, island, first, last, n: runs of rows with an equal value."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    change = F.when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = rows.withColumn("__change", change).withColumn("island", F.sum("__change").over(w))
    return marked.groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def longest_run(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """by, first, last, n of each one's longest run of equal values, the earliest of equally long ones."""
    best = islands(rows, by, order, value).groupBy(by).agg(F.max(F.struct("n", (-F.col("first")).alias("minus"), "last")).alias("x"))
    return best.select(by, (-F.col("x.minus")).alias("first"), F.col("x.last").alias("last"), F.col("x.n").alias("n"))


def landing(bars: DataFrame, by: str, order: str, value: str, wide: int = 4, aligned: int = 8, share: float = 0.8) -> DataFrame:
    """by, bar: the first aligned bar (from 0) whose mean with the next ones reaches a share of the peak of such means."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    means = bars.select(by, (F.row_number().over(w) - 1).alias("bar"), F.round(F.avg(value).over(w.rowsBetween(0, wide - 1)), 6).alias("mean"))
    peak = means.withColumn("peak", F.max("mean").over(Window.partitionBy(by)))
    return peak.where((F.col("bar") % aligned == 0) & (F.col("mean") >= F.col("peak") * share)).groupBy(by).agg(F.min("bar").cast("long").alias("bar"))
