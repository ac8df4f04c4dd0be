"""Names for the regions of a drawn map: a k-d split of its points, and the tag that sets each region apart.

Regions are the cells of a binary tree: a cell's points are cut at the median of the axis on which they are
further apart (the first one if equal), ties by item. Cell k has the children 2k + 1 and 2k + 2. Cells from FIRST
to LAST in depth, of LEAST points or more, get names.

* The split goes level by level. Cells of more than IN_TASK points are cut by places from a range sort, so
  that no task holds a whole one; smaller cells are cut down to the end in one task each.
* Tags are counted per leaf first, then summed up the tree, all levels at once.
* A tag that names a region above is skipped. At most LAST - FIRST names are above one, so each cell's
  LAST - FIRST + 1 best tags are enough to choose from: some thousand rows, whatever the map's size.
* Middles and widths are order statistics, found by places again.

Defined results: a point without coordinates is in no region. Of repeated items all rows count. An item without
tags counts for the regions' sizes only. A cell where no tag is common enough has no row, and gives no
name away. Null tags name nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.operators.ranking import placed_in_group, top_per_group
from affinia.operators.shared import stored

FIRST, LAST, LEAST = 2, 9, 8
#: A tag on fewer titles names nothing; nor does one on a smaller share of a region, or on fewer titles there.
LEAST_DF, LEAST_SHARE, LEAST_COUNT = 2, 0.05, 2
#: Points of a cell that one task cuts.
IN_TASK = 200_000


def depth(node: Column) -> Column:
    return F.floor(F.log2(node + 1)).cast("int")


def above(node: Column, level: Column) -> Column:
    """The cell at a level that holds a cell."""
    return F.call_function("shiftright", node + 1, depth(node) - level) - 1


def _halved(cells: DataFrame) -> DataFrame:
    """One level further: each cell's points go to its children."""
    span = lambda c: F.max(c) - F.min(c)
    wide = stored(cells.groupBy("node").agg((span("x") >= span("y")).alias("by_x")), "axes")
    cut = cells.join(wide, "node").withColumn("__v", F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y")))
    placed = placed_in_group(cut, ["node"], [F.col("__v"), F.col("item")])
    right = F.col("place") >= F.floor(F.col("size") / 2)
    return placed.select("item", "x", "y", (2 * F.col("node") + 1 + right.cast("long")).alias("node"))


def _cut(pdf: pd.DataFrame, last: int, least: int) -> pd.DataFrame:
    """The leaf of each point of one cell."""
    x, y, node = pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.node.to_numpy().copy()
    by_item = np.argsort(pdf.item.to_numpy(), kind="stable")
    todo = [(int(node[0]), by_item)]
    while todo:
        k, some = todo.pop()
        node[some] = k
        if len(some) < least or (k + 1).bit_length() - 1 >= last:
            continue
        v = x[some] if np.ptp(x[some]) >= np.ptp(y[some]) else y[some]
        # some is in the order of items, and stays so in each half's ties.
        order = np.argsort(v, kind="stable")
        left = np.zeros(len(some), bool)
        left[order[: len(some) // 2]] = True
        todo += [(2 * k + 1, some[left]), (2 * k + 2, some[~left])]
    return pdf.assign(node=node)


def leaves(points: DataFrame, last: int = LAST, least: int = LEAST, in_task: int = IN_TASK) -> DataFrame:
    """item, x, y, node: the deepest cell of each point, at most so deep; cells under least points aren't cut. points: item, x, y."""
    cells = points.where("x IS NOT NULL AND y IS NOT NULL").select("item", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0).cast("long").alias("node"))
    cells = stored(cells, "points")
    largest, level = cells.count(), 0
    while largest > max(in_task, least) and level < last:
        cells, level, largest = stored(_halved(cells), "cells"), level + 1, -(-largest // 2)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return stored(cells.groupBy("node").applyInPandas(lambda pdf: _cut(pdf, last, least), schema), "leaves")


def _regions(cells: DataFrame, first: int, last: int) -> DataFrame:
    """cells, once for each region that holds them, from first to last in depth."""
    levels = F.sequence(F.lit(first), F.least(depth(F.col("node")), F.lit(last)))
    held = cells.where(depth(F.col("node")) >= first)
    return held.withColumn("__level", F.explode(levels)).withColumn("node", above(F.col("node"), F.col("__level"))).drop("__level")


def _candidates(cells: DataFrame, tagged: DataFrame, sizes: DataFrame, exclude: Iterable[str], first: int, last: int) -> DataFrame:
    """node, tag, place: the best tags of each region."""
    df = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= LEAST_DF)
    df = df.where(F.col("tag").isNotNull() & ~F.coalesce(F.col("tag").isin(list(exclude)), F.lit(False)))
    titles = tagged.agg(F.count_distinct("item").alias("titles"))
    in_leaf = cells.select("item", "node").join(tagged, "item").groupBy("node", "tag").agg(F.count(F.lit(1)).alias("n"))
    counts = _regions(in_leaf, first, last).groupBy("node", "tag").agg(F.sum("n").alias("n"))
    common = F.col("n") >= F.greatest(F.lit(float(LEAST_COUNT)), F.lit(LEAST_SHARE) * F.col("size"))
    score = F.col("n") * (1.0 + F.log(F.col("titles") / F.col("df")))
    named = counts.join(sizes, "node").where(common).join(df, "tag").crossJoin(F.broadcast(titles))  # one row
    return top_per_group(named.withColumn("score", score), ["node"], [F.desc("score"), F.asc("tag")], last - first + 1).select("node", "tag", "place")


def _names(candidates: DataFrame, first: int) -> DataFrame:
    """node, tag: each region's first tag that names none above it. A group is a region of the first level and all in it."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[int, str] = {}
        for node, some in pdf.sort_values(["node", "place"]).groupby("node", sort=True):
            used, k = set(), int(node)
            while k:
                k = (k - 1) // 2
                used.add(names.get(k))
            free = [t for t in some.tag if t not in used]
            if free:
                names[int(node)] = free[0]
        return pd.DataFrame({"node": list(names.keys()), "tag": list(names.values())}).astype({"node": "int64", "tag": "object"})

    roots = candidates.withColumn("root", above(F.col("node"), F.lit(first)))
    return roots.groupBy("root").applyInPandas(choose, "node long, tag string")


def _spans(cells: DataFrame, first: int, last: int, least: int) -> DataFrame:
    """node, size, and the middle and width of each axis: the upper median, and from the 10th to the 90th percentile."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("x", "y")]))
    values = _regions(cells, first, last).select("node", axes.alias("__a")).select("node", "__a.axis", "__a.v")
    placed = placed_in_group(values, ["node", "axis"], [F.col("v")]).where(F.col("size") >= least)
    last_place = F.col("size") - 1
    at = {"mid": F.floor(F.col("size") / 2), "low": F.floor(F.lit(0.1) * last_place), "high": F.floor(F.lit(0.9) * last_place)}
    picked = {name: F.max(F.when(F.col("place") == where, F.col("v"))).alias(name) for name, where in at.items()}
    each = placed.groupBy("node", "axis").agg(F.max("size").alias("size"), *picked.values())
    of = lambda axis, value: F.max(F.when(F.col("axis") == axis, value))
    wide = F.col("high") - F.col("low")
    return each.groupBy("node").agg(
        F.max("size").alias("size"),
        F.round(of("x", F.col("mid")), 4).alias("x"),
        F.round(of("y", F.col("mid")), 4).alias("y"),
        F.round(of("x", wide), 4).alias("width"),
        F.round(of("y", wide), 4).alias("height"),
    )


def region_labels(points: DataFrame, tagged: DataFrame, exclude: Iterable[str] = (), first: int = FIRST, last: int = LAST, least: int = LEAST, in_task: int = IN_TASK) -> DataFrame:
    """node, x, y, width, height, titles, tag of each named region, coarse to fine. points: item, x, y; tagged: item, tag (distinct)."""
    cells = leaves(points, last, least, in_task)
    spans = stored(_spans(cells, first, last, least), "spans")
    names = _names(_candidates(cells, tagged, spans.select("node", "size"), exclude, first, last), first)
    return spans.join(names, "node").select("node", "x", "y", "width", "height", F.col("size").cast("long").alias("titles"), "tag")


def labelled_points(points: DataFrame, tagged: DataFrame, exclude: Iterable[str] = (), in_task: int = IN_TASK) -> DataFrame:
    """item, node, tag: the finest named region of each point, null where none holds it."""
    cells = leaves(points, in_task=in_task)
    spans = stored(_spans(cells, FIRST, LAST, LEAST), "spans")
    names = _names(_candidates(cells, tagged, spans.select("node", "size"), exclude, FIRST, LAST), FIRST)
    within = _regions(cells.select("item", "node"), FIRST, LAST).join(stored(names, "names"), "node")
    best = within.groupBy("item").agg(F.max("node").alias("node"), F.max_by("tag", "node").alias("tag"))
    return points.select("item").distinct().join(best, "item", "left")
