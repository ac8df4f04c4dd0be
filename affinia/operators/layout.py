"""A map of titles: tag vectors, a seeded projection onto signs, and a layout in the unit square.

* Vectors: tags on LEAST_DF titles or more, weighted by 1 + ln(titles / df), of unit length. With more than DIMS
  tags they are projected: each tag has DIMS random signs that depend on the seed and its number alone.
* Layout: the two main axes of the vectors, from sums of products that every task adds up; then some rounds of power
  iteration over the graph of nearest titles, started from those axes, which pulls neighbours together. It is
  this library's own layout: places differ from other layouts, neighbours stay near each other.
* Both axes are scaled by one factor, so that the longer one spans 0 to 1.

Only matrices of DIMS x DIMS numbers and the sums of two columns reach the driver, whatever the number of titles.

Defined results: with fewer than 5 titles or 3 tags the titles are on a line, in order. A title none of whose
tags counts has no place. The axes' signs are fixed by their largest entry.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.operators.ranking import placed_in_group
from affinia.operators.shared import stored
from affinia.operators.upkeep import unit_square

DIMS, SEED, LEAST_DF = 256, 1, 2
#: Titles and tags below which there is no layout.
FEWEST_TITLES, FEWEST_TAGS = 5, 3
ROUNDS = 6

#: The step and the two factors of the SplitMix64 generator.
STEP, FIRST_FACTOR, SECOND_FACTOR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def split_mix(state: np.ndarray) -> np.ndarray:
    """The number that SplitMix64 gives in each state."""
    z = state.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST_FACTOR)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND_FACTOR)
    return z ^ (z >> np.uint64(31))


def sign_words(columns: np.ndarray, seed: int, dims: int = DIMS) -> np.ndarray:
    """A row of dims / 64 words of random bits for each column number."""
    start = np.uint64(seed) ^ (columns.astype(np.uint64) * np.uint64(STEP))
    steps = np.arange(1, dims // 64 + 1, dtype=np.uint64) * np.uint64(STEP)
    return split_mix(start[:, None] + steps)


def signs(columns: np.ndarray, seed: int, dims: int = DIMS) -> np.ndarray:
    """A row of dims signs (+1 and -1) for each column number: the bits of its words, from the lowest."""
    words = np.ascontiguousarray(sign_words(columns, seed, dims))
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def sign_table(tags: DataFrame, seed: int = SEED) -> DataFrame:
    """tag, column, word, bits (16 hexadecimal digits) of each tag. tags: tag, column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = sign_words(f.column.to_numpy(), seed)
            n = words.shape[1]
            yield pd.DataFrame({"tag": f.tag.repeat(n).to_numpy(), "column": f.column.repeat(n).to_numpy(), "word": np.tile(np.arange(n, dtype=np.int32), len(f)), "bits": [f"{w:016x}" for w in words.ravel().tolist()]})

    return tags.select("tag", F.col("column").cast("long").alias("column")).mapInPandas(run, "tag string, column long, word int, bits string")


def weighted(tagged: DataFrame, exclude: Iterable[str] = (), least_df: int = LEAST_DF) -> tuple[DataFrame, DataFrame]:
    """item, column, value of each title's tags that count, and the vocabulary: tag, column (in order of the tags). tagged: item, tag (distinct)."""
    titles = tagged.agg(F.count_distinct("item").alias("titles"))
    df = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    counted = df.where((F.col("df") >= least_df) & F.col("tag").isNotNull() & ~F.coalesce(F.col("tag").isin(list(exclude)), F.lit(False)))
    vocabulary = stored(placed_in_group(counted, [], [F.col("tag")], "column").select("tag", "column", "df"), "vocabulary")
    value = 1.0 + F.log(F.col("titles") / F.col("df"))
    cells = tagged.join(vocabulary, "tag").crossJoin(F.broadcast(titles)).select("item", "column", value.alias("value"))  # one row
    return cells, vocabulary.select("tag", "column")


def vectors(cells: DataFrame, columns: int, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """item, vector: the unit vectors of the titles, projected if there are more than dims columns. cells: item, column, value.

    Values are added one after the other in order of their columns, in 32 bits, so that no partitioning changes one.
    """
    width = min(columns, dims)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f.cells.map(len).to_numpy()
            order = np.argsort(-sizes, kind="stable")  # the longest first: those still adding are a prefix
            col = [np.array([c["column"] for c in some], np.int64) for some in f.cells]
            val = [np.array([c["value"] for c in some]) for some in f.cells]
            val = [(v / np.sqrt(np.sum(v * v))).astype(np.float32) for v in val]
            out = np.zeros((len(f), width), np.float32)
            for k in range(int(sizes.max(initial=0))):
                rows = order[: int(np.searchsorted(-sizes[order], -k, "left"))]
                at, add = np.array([col[r][k] for r in rows], np.int64), np.array([val[r][k] for r in rows], np.float32)
                if columns <= dims:
                    out[rows, at] += add
                else:
                    out[rows] += add[:, None] * signs(at, seed, dims)
            yield pd.DataFrame({"item": f["item"], "vector": list(out)})

    kind = cells.schema["item"].dataType.simpleString()
    grouped = cells.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("cells"))  # a title's tags
    return grouped.mapInPandas(run, f"item {kind}, vector array<float>")


def main_axes(rows: DataFrame, width: int, axes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the main axes of item, vector. Tasks send the upper half of their sums of products, which Spark adds up."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width).astype(np.float64)
            total, products, n = total + x.sum(axis=0), products + x.T @ x, n + len(x)
        values = np.concatenate(([n], total, products[i, j]))
        yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

    sums = rows.select("vector").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + width + len(i))
    for r in sums.collect():  # 1 + width + width * (width + 1) / 2 rows
        values[r["at"]] = r["value"]
    n = max(values[0], 1)
    mean = values[1 : 1 + width] / n
    products = np.zeros((width, width))
    products[i, j] = products[j, i] = values[1 + width :]
    found = np.linalg.eigh(products / n - np.outer(mean, mean))[1][:, ::-1][:, :axes]
    heads = found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])]
    return mean, found * np.where(heads < 0, -1.0, 1.0)


def on_axes(rows: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """item, x, y: the vectors along two axes."""

    def along(k: int) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in axes[:, k]])
        moved = F.aggregate(F.zip_with("vector", weights, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda a, b: a + b)
        return moved - float(mean @ axes[:, k])

    return rows.select("item", along(0).alias("x"), along(1).alias("y"))


def pulled(points: DataFrame, near: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """points (item, x, y) after rounds of power iteration over the graph near (item, other, weight).

    A round puts each title half way to the weighted middle of its neighbours; then the columns are centred and made
    orthogonal and of equal length, so that they go on to the graph's slow directions and don't fall together.
    """
    both = near.unionByName(near.select(F.col("other").alias("item"), F.col("item").alias("other"), "weight"))
    edges = stored(both.groupBy("item", "other").agg(F.max("weight").alias("weight")), "near")
    at = stored(points, "points")
    for _ in range(rounds):
        of_other = at.select(F.col("item").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        middle = edges.join(of_other, "other").groupBy("item").agg(*[(F.sum(F.col(o) * F.col("weight")) / F.sum("weight")).alias(o) for o in ("ox", "oy")])
        half = lambda c: (F.col(c) + F.coalesce(f"o{c}", c)) / 2
        moved = stored(at.join(middle, "item", "left").select("item", half("x").alias("x"), half("y").alias("y")), "moved")
        s = moved.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
        n = max(s["n"], 1)
        mx, my = (s["x"] or 0.0) / n, (s["y"] or 0.0) / n
        xx, xy, yy = ((s[k] or 0.0) / n - m for k, m in (("xx", mx * mx), ("xy", mx * my), ("yy", my * my)))
        slope = xy / xx if xx > 0 else 0.0
        rest = max(yy - slope * xy, 0.0)
        x = (F.col("x") - mx) / (xx**0.5 if xx > 0 else 1.0)
        y = (F.col("y") - my - slope * (F.col("x") - mx)) / (rest**0.5 if rest > 0 else 1.0)
        at = moved.select("item", x.alias("x"), y.alias("y"))
    return at


def title_map(tagged: DataFrame, near: DataFrame | None = None, exclude: Iterable[str] = (), seed: int = SEED, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """item, x, y of each title that has a tag that counts. tagged: item, tag (distinct); near: item, other, weight of nearest titles."""
    cells, vocabulary = weighted(tagged, exclude)
    cells = stored(cells, "cells")
    columns, titles = vocabulary.count(), cells.select("item").distinct().count()
    if titles < FEWEST_TITLES or columns < FEWEST_TAGS:
        placed = placed_in_group(cells.select("item").distinct(), [], [F.col("item")])
        return placed.select("item", (F.col("place") / F.greatest(F.col("size") - 1, F.lit(1))).alias("x"), F.lit(0.5).alias("y"))
    rows = stored(vectors(cells, columns, seed, dims), "vectors")
    points = on_axes(rows, *main_axes(rows, min(columns, dims)))
    points = pulled(points, near, rounds) if near is not None else points
    square = unit_square(stored(points, "laid").withColumnRenamed("item", "id"))
    return square.select(F.col("id").alias("item"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
