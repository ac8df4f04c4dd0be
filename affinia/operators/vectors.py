"""Vectors: cosine, search with negatives, seeded draws, statistics of a match, Chamfer scores of pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.operators.products import CELLS, best, paired
from affinia.operators.ranking import top_per_group
from affinia.operators.shared import stored

#: Rows of a block in a product of all pairs, at least and at most, and blocks that there are up to the most.
BLOCK, MOST, BLOCKS = 1024, 32_768, 16


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed in order in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the widths differ."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(0.0)


def constant(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def quantized(vector: Column) -> Column:
    """A vector as 8-bit numbers, scaled by its largest entry; ties go to even."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.transform(vector, lambda x: F.when(most > 0, F.bround(x.cast("double") * 127 / most)).otherwise(0.0).cast("tinyint"))


def shot_scores(frames: DataFrame, phrase: Sequence[float], negatives: Sequence[Sequence[float]] = (), weight: float = 0.5, digits: int = 6) -> DataFrame:
    """item, shot, score: the best frame for the phrase, less the best for any negative. frames: item, shot, t_ms, vector."""
    sims = [F.max(cosine(F.col("vector"), constant(v))) for v in (phrase, *negatives)]
    best = frames.groupBy("item", "shot").agg(*[s.alias(f"s{i}") for i, s in enumerate(sims)])
    worst = F.greatest(*[F.col(f"s{i}") for i in range(1, len(sims))], F.lit(-1.0)) if negatives else F.lit(0.0)
    return best.select("item", "shot", F.round(F.col("s0") - weight * worst, digits).alias("score"))


def softmax(scored: DataFrame, temperature: float, column: str = "score") -> DataFrame:
    """scored with the probability of each row, shifted by the largest score; two aggregates of one row."""
    top = scored.agg(F.max(column).alias("__top"))
    raised = scored.crossJoin(F.broadcast(top)).withColumn("__e", F.exp((F.col(column) - F.col("__top")) / temperature))
    total = raised.agg(F.sum("__e").alias("__sum"))
    return raised.crossJoin(F.broadcast(total)).withColumn("probability", F.col("__e") / F.col("__sum")).drop("__e", "__top", "__sum")


def draw(scored: DataFrame, n: int, seed: int, temperature: float, key: Sequence[str]) -> DataFrame:
    """n rows without replacement, with chances of exp(score / temperature), the same for the same seed.

    Each row gets a Gumbel number from a hash of its key and the seed; the n largest sums win, so that
    the draw is one top-n over the rows.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    chance = F.col("score") / temperature - F.log(-F.log(u))
    return scored.withColumn("__chance", chance).orderBy(F.desc("__chance"), *key).limit(n).drop("__chance")


def match_statistics(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, median, 99th percentile (interpolated) and largest score."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("score"), 6).alias("median"), F.round(F.percentile("score", F.lit(0.99)), 6).alias("p99"), F.max("score").alias("best"))


def peaks(series: DataFrame, spacing_ms: int = 120_000, most: int = 4) -> DataFrame:
    """item, t_ms, score, place: the best moments of each item that are far enough apart. A fold per item."""
    entry = F.struct((-F.col("score")).alias("minus"), "t_ms")
    ordered = series.groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))

    def take(kept: Column, x: Column) -> Column:
        far = F.forall(kept, lambda k: F.abs(k["t_ms"] - x["t_ms"]) >= spacing_ms)
        return F.when((F.size(kept) < most) & far, F.concat(kept, F.array(x))).otherwise(kept)

    found = ordered.select("item", F.posexplode(F.aggregate("all", none, take)).alias("i", "x"))
    return found.select("item", F.col("x.t_ms").alias("t_ms"), (-F.col("x.minus")).alias("score"), (F.col("i") + 1).cast("long").alias("place"))


def chamfer(frames: DataFrame, candidates: DataFrame, per_piece: int = MOST, per_group: int = MOST) -> DataFrame:
    """a, b, score: the mean of each frame's best match, the smaller of both directions. frames: item, t_ms, vector; candidates: a, b.

    An item's frames are cut into pieces, and each pair of pieces of a candidate is one product of matrices; small
    ones share a group. A frame is copied once for each piece of each item that its own is compared with.
    """
    whole = F.when(~F.exists("vector", lambda x: x.isNull()), F.col("vector"))
    cut = frames.select("item", "t_ms", whole.alias("vector"))
    sizes = stored(cut.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "sizes")
    pieces = sizes.select("item", F.ceil(F.col("n") / per_piece).cast("int").alias("pieces"))
    cut = cut.join(pieces, "item").withColumn("piece", F.pmod(F.xxhash64("t_ms"), F.col("pieces")).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    jobs = candidates.select("a", "b").distinct().join(pieces.toDF("a", "na"), "a").join(pieces.toDF("b", "nb"), "b")
    jobs = stored(jobs.withColumn("pa", upto("na")).withColumn("pb", upto("nb")).select("a", "b", "pa", "pb"), "jobs")
    sides = [jobs.select("a", "b", "pa", "pb", F.col(x).alias("item"), F.col(p).alias("piece"), F.lit(k).alias("side")) for k, (x, p) in enumerate((("a", "pa"), ("b", "pb")))]
    rows = jobs.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b").join(pieces.toDF("a", "na"), "a").join(pieces.toDF("b", "nb"), "b")
    sent = rows.agg(F.sum(F.col("n") / F.col("na") + F.col("m") / F.col("nb"))).first()[0] or 0
    group = F.pmod(F.xxhash64("a", "b", "pa", "pb"), F.lit(max(1, int(sent // per_group)))).alias("group")
    met = sides[0].unionByName(sides[1]).join(cut.drop("pieces"), ["item", "piece"]).select(group, "a", "b", "pa", "pb", "side", "t_ms", "vector")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pdf[["a", "b", "side", "t_ms"]][:0].assign(s=0.0)]
        for _, job in pdf.groupby(["a", "b", "pa", "pb"], sort=False):
            one, two = job[job.side == 0], job[job.side == 1]
            if len(one) and len(two):
                ends = [best_cosines(x.vector.tolist(), y.vector.tolist()) for x, y in ((one, two), (two, one))]
                out += [x[["a", "b", "side", "t_ms"]].assign(s=s) for x, s in zip((one, two), ends, strict=True)]
        return pd.concat(out[1:] or out)

    kinds = dict(frames.dtypes)
    best_of = met.groupBy("group").applyInPandas(products, f"a {kinds['item']}, b {kinds['item']}, side int, t_ms {kinds['t_ms']}, s double")
    means = best_of.groupBy("a", "b", "side", "t_ms").agg(F.max("s").alias("s")).groupBy("a", "b", "side").agg(F.avg("s").alias("mean"))
    return means.groupBy("a", "b").agg(F.round(F.min("mean"), 6).alias("score"))


def best_cosines(rows: list, others: list) -> np.ndarray:
    """Each row's largest cosine with any of the others; 0 with one of another width, a null or a zero vector."""
    widths = [np.array([-1 if v is None else len(v) for v in some]) for some in (rows, others)]
    out = np.full(len(rows), -np.inf)
    for width in np.unique(widths[0]):
        mine, theirs = np.flatnonzero(widths[0] == width), np.flatnonzero(widths[1] == width)
        if len(theirs) < len(others) or width < 1:
            out[mine] = 0.0
        if len(theirs) and width > 0:
            x, y = (np.stack([some[k] for k in at]).astype(np.float64) for some, at in ((rows, mine), (others, theirs)))
            x, y = (v / np.where(n > 0, n, 1) for v, n in ((v, np.linalg.norm(v, axis=1, keepdims=True)) for v in (x, y)))
            step = max(1, CELLS // len(y))
            most = np.concatenate([(x[low : low + step] @ y.T).max(axis=1) for low in range(0, len(x), step)])
            out[mine] = np.maximum(out[mine], most)
    return out


def nearest_vectors(rows: DataFrame, top: int, least: float, per_block: int | None = None) -> DataFrame:
    """id, other, cosine, place: all pairs in blocks, as products of matrices. rows: id, vector.

    Each pair of blocks is a group, whose rows give their top-k both ways; the best of those remain. A row is copied
    once for each block. Blocks grow with the rows from BLOCK to MOST, so that up to BLOCKS * MOST rows the
    copies grow as the rows do; beyond that a task's matrices stay as they are, and the copies of a row grow.
    """
    count = rows.count()
    per_block = per_block or min(max(BLOCK, -(-count // BLOCKS)), MOST)
    blocks = max(1, -(-count // per_block))
    cut = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        sides = []
        for side in (i, j):
            some = pdf[pdf.block == side]
            x = np.stack(some.vector.to_numpy()).astype(np.float64) if len(some) else np.zeros((0, 1))
            sides.append((some.id.to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))
        found = [pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})]
        if len(sides[0][0]) and len(sides[1][0]):
            for (ids, x), (others, y) in (sides, sides[::-1]) if i < j else (sides,):
                found += [pd.DataFrame({"id": ids[a], "other": others[b], "cosine": v}) for a, b, v in best(lambda low, high, x=x, y=y: x[low:high] @ y.T, ids, others, top, least)]
        return pd.concat(found[1:] or found)

    found = paired(cut, blocks).groupBy("i", "j").applyInPandas(products, "id long, other long, cosine double")
    return top_per_group(found, ["id"], [F.desc("cosine"), F.asc("other")], top)


def ranking_agreement(a: DataFrame, b: DataFrame, by: str, k: int) -> DataFrame:
    """by, shared, same_first: how two rankings (by, id, place) agree in their first k."""
    tops = [r.where(F.col("place") <= k).select(by, F.struct("place", "id").alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias(n)) for r, n in ((a, "p"), (b, "q"))]
    return tops[0].join(tops[1], by).select(by, F.size(F.array_intersect("p", "q")).cast("long").alias("shared"), (F.get("p", F.lit(0)) == F.get("q", F.lit(0))).alias("same_first"))


def half(x: Column) -> Column:
    """A double rounded to the nearest number of 16 bits, ties to even; too large ones are infinite."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    near = F.rint(x / step) * step
    return F.when(size >= 65520, F.signum(x) * float("inf")).when(size == 0, x).otherwise(near)
