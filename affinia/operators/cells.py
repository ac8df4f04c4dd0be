"""Nearest vectors through an index of cells with exact bounds.

Centroids are fitted on a bounded sample; every distinct vector lies in the cell of its nearest centroid, and large
cells are cut into rings by the angle to it. A vector first meets its own block, which bounds how near its
neighbours must at least be. It then visits only the blocks that can hold one so near, by two bounds that lose nothing:
vectors of another cell lie beyond the plane between both centroids, and angles to a centroid differ at most by
the angle between two vectors. Where vectors lie in clusters a row is copied to a few blocks, however many
rows there are; where they are random, no bound holds off much, and rows would visit most blocks. If they would visit
more than COPIES on average, blocks are joined to areas of a COPIES-th of the rows, which rows visit instead: a row
is then copied COPIES times or a few more, however many blocks there are, until an area has AREA numbers.

Equal vectors are one: a group of copies keeps its first ids, as many as an answer can name, and each copy
gets the group's answer. A vector that many blocks' rows visit meets them in lots, so that no task holds more than
a block and a lot.

Defined results: null, empty and zero vectors, those with a null or a number that isn't finite, and null ids have no
neighbours; a row that is repeated counts once; equal cosines (rounded to six digits) rank by id. An empty table has an
empty answer. All vectors must have one width, and least must be above 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.ranking import top_per_group
from affinia.operators.shared import stored

#: Rows of a block, of a lot of visitors, and of those that are compared at once.
BLOCK, LOT, SLICE = 4096, 8192, 512
#: Vectors that the centroids are fitted on, at most, and centroids, at most: both go through the driver.
SAMPLE, MOST_CELLS = 16_384, 1024
#: Visits of a row, beyond which blocks are joined; numbers of an area's vectors, at most; and cosines that a task holds at once.
COPIES, AREA, COSINES = 16, 1 << 23, 1 << 22
STEPS = 6
#: Bounds are widened by this much, for the rounding of cosines and angles.
SLACK = 2e-6


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit length, by a few steps from evenly spread rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(STEPS):
        sums = np.zeros_like(centroids)
        np.add.at(sums, (sample @ centroids.T).argmax(axis=1), sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def _distinct(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """id, same of each row that has neighbours; and same, vector, ids (the first top + 1) of each distinct vector."""
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.select("id", "vector").where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    named = usable.withColumn("same", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256)).dropDuplicates(["id", "same"])
    firsts = top_per_group(named, ["same"], [F.asc("id")], top + 1)
    return named.select("id", "same"), firsts.groupBy("same").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def _placed(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row, same, vector, ids, cell, angle of each distinct vector."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                near = _units(pdf.vector) @ centroids.T
                yield pdf.assign(cell=near.argmax(axis=1).astype(np.int32), angle=np.arccos(np.clip(near.max(axis=1), -1, 1)))

    schema = f"row long, same string, vector {distinct.schema['vector'].dataType.simpleString()}, ids array<long>, cell int, angle double"
    return stored(distinct.select("row", "same", "vector", "ids").mapInPandas(place, schema), "placed")


def _blocks(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed with ring and sub; and cell, ring, lo, hi, subs of each ring. A ring of too many rows is cut by hash."""
    whole = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("rings"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("angle") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    ringed = placed.join(whole, "cell").withColumn("ring", F.least(F.floor(share * F.col("rings")), F.col("rings") - 1).cast("int")).drop("rings", "lo", "hi")
    rings = stored(ringed.groupBy("cell", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("subs")), "rings")
    cut = ringed.join(rings.select("cell", "ring", "subs"), ["cell", "ring"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")).drop("subs")
    return stored(cut, "blocks"), rings


def _best(visitors: pd.DataFrame, block: pd.DataFrame, top: int, settled: bool = True) -> pd.DataFrame:
    """row, other, cosine, bar: the first top + 1 ids of a block for each visitor, and how near such must be at least.

    Bars that aren't settled are raised to what the block itself holds.
    """
    found = [pd.DataFrame({"row": [], "other": [], "cosine": [], "bar": []}).astype({"row": "int64", "other": "int64", "cosine": "float64", "bar": "float64"})]
    if len(block):
        count = block.ids.map(len).to_numpy()
        hosts = _units(block.vector), np.concatenate(block.ids.to_numpy()), np.cumsum(count) - count, count
        step = max(1, min(SLICE, COSINES // len(block)))
        found += [_best_of(visitors.iloc[at : at + step], hosts, top, settled) for at in range(0, len(visitors), step)]
    return pd.concat(found[1:] or found)


def _best_of(visitors: pd.DataFrame, hosts: tuple, top: int, settled: bool) -> pd.DataFrame:
    units, ids, first, count = hosts
    cos = _units(visitors.vector) @ units.T
    bar = visitors.bar.to_numpy(np.float64).copy()
    if not settled and len(units) > top:
        bar = np.maximum(bar, np.round(np.partition(cos, len(units) - top - 1, axis=1)[:, len(units) - top - 1], 6))
    i, j = np.nonzero(cos >= bar[:, None] - SLACK)
    each = np.repeat(np.arange(len(i)), count[j])
    within = np.arange(len(each)) - np.repeat(np.cumsum(count[j]) - count[j], count[j])
    other, i, c = ids[first[j[each]] + within], i[each], np.round(cos[i[each], j[each]], 6)
    order = np.lexsort((other, -c, i))
    i, other, c = i[order], other[order], c[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, other, c = i[place <= top], other[place <= top], c[place <= top]
    return pd.DataFrame({"row": visitors.row.to_numpy()[i], "other": other, "cosine": c, "bar": bar[i]})


def visits(placed: DataFrame, rings: DataFrame, bars: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row, cell, ring, sub: the blocks, its own aside, that each row has to visit. bars: row, bar."""
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2) if len(centroids) <= 256 else None

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                near = _units(pdf.vector) @ centroids.T
                own = pdf.cell.to_numpy()
                wide = np.arccos(np.clip(pdf.bar.to_numpy() - SLACK, -1, 1)) + SLACK
                gap = apart[own] if apart is not None else np.sqrt(np.maximum(2 - 2 * centroids[own] @ centroids.T, 0))
                beyond = (near[np.arange(len(pdf)), own][:, None] - near) / np.maximum(gap, 1e-6)
                beyond[gap < 1e-6] = 0
                i, j = np.nonzero(np.arcsin(np.clip(beyond, -1, 1)) <= wide[:, None] + SLACK)
                angle = np.arccos(np.clip(near[i, j], -1, 1))
                yield pd.DataFrame({"row": pdf.row.to_numpy()[i], "cell": j.astype(np.int32), "own_cell": own[i], "own_ring": pdf.ring.to_numpy()[i], "own_sub": pdf["sub"].to_numpy()[i], "least": angle - wide[i] - SLACK, "most": angle + wide[i] + SLACK})

    asked = placed.select("row", "vector", "cell", "ring", "sub").join(bars, "row").mapInPandas(reach, "row long, cell int, own_cell int, own_ring int, own_sub int, least double, most double")
    met = asked.join(rings, "cell").where("lo <= most AND hi >= least").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs").cast("int") - 1)))
    return met.where("cell <> own_cell OR ring <> own_ring OR sub <> own_sub").select("row", "cell", "ring", "sub")


def close_vectors(rows: DataFrame, top: int, least: float) -> DataFrame:
    """id, other, cosine, place: the first top others of a cosine of at least least, all of them exact. rows: id, vector."""
    if least <= 0:
        raise ValueError("least must be above 0")
    named, distinct = _distinct(rows, top)
    distinct = stored(distinct.withColumn("row", F.monotonically_increasing_id()), "distinct")
    sample = distinct.select("same", "vector").orderBy("same").limit(SAMPLE).toPandas()
    if not len(sample):
        return named.select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"), F.lit(1).cast("long").alias("place")).limit(0)
    cells = min(MOST_CELLS, -(-2 * distinct.count() // BLOCK))
    centroids = _centroids(_units(sample.vector), cells)
    placed, rings = _blocks(_placed(distinct, centroids))
    made = "row long, other long, cosine double, bar double"

    keys = ["cell", "ring", "sub"]
    own = stored(placed.groupBy(*keys).applyInPandas(lambda pdf: _best(pdf.assign(bar=least), pdf, top, settled=False), made), "own")
    bars = own.groupBy("row").agg(F.max("bar").alias("bar"))
    asked = visits(placed, rings, bars, centroids)
    count, crowded = placed.count(), asked.count()
    crowded = crowded > COPIES * count
    size = max(BLOCK, min(-(-count // COPIES), AREA // len(sample.vector.iloc[0]))) if crowded else 1
    # A row for each block: an area is a stretch of blocks, or a single one.
    blocks = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    areas = stored(blocks.select(*keys, F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).alias("area")), "areas")
    asked = asked.join(areas, keys).select("row", "area")
    if crowded:
        asked = asked.unionByName(placed.join(areas, keys).select("row", "area")).distinct()
    asked = stored(asked, "visits")
    lots = stored(asked.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / max(LOT, size)).cast("int").alias("lots")), "lots")
    guests = asked.join(lots, "area").withColumn("lot", F.pmod(F.xxhash64("row"), F.col("lots")).cast("int"))
    guests = guests.join(placed.select("row", "vector").join(bars, "row"), "row").select("area", "lot", "row", "vector", F.lit(None).cast("array<long>").alias("ids"), "bar")
    hosts = placed.join(areas, keys).join(lots, "area").select("area", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "row", "vector", "ids", F.lit(None).cast("double").alias("bar"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        guest = pdf.ids.isna()
        return _best(pdf[guest], pdf[~guest], top)

    met = guests.unionByName(hosts).groupBy("area", "lot").applyInPandas(meet, made)
    met = met if crowded else own.unionByName(met)  # areas hold a row's own block
    best = top_per_group(met.where(F.col("cosine") >= least).drop("bar"), ["row"], [F.desc("cosine"), F.asc("other")], top + 1)
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "other"))).alias("best"))  # top + 1 at most
    answers = lists.join(placed.select("row", "same"), "row").select("same", "best")
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, top)
    each = named.join(answers, "same").select("id", F.posexplode(others).alias("i", "x"))
    return each.select("id", F.col("x.other").alias("other"), (-F.col("x.minus")).alias("cosine"), (F.col("i") + 1).cast("long").alias("place"))
