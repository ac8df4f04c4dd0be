"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source; each source gets a target; a document is taken floor(rate) times, and
once more when a number drawn from a hash of its id and the seed is below the rate's fraction.

Defined results: a null text has size 0, a null source is a source of its own and comes last, a
source without words has target 0 and takes nothing. Repeated rows are mixed each on its own, with
the same draw. Reruns agree, as draws depend on ids and the seed alone. Extra columns pass through
`mix` unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import WORD, ranked, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: A target is at most so many times its source's size.
MOST = 2.0
SEED = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. sizes has source and size.

    The excess over a cap is shared again by weight until no target is above its cap. With a common
    level, target = min(cap, level * weight): each round raises the level by what the capped sources
    leave over. A round is one aggregate over the sources; three numbers reach the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = stored(ranked(sums, F.col("source").asc_nulls_last()), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    level, left = 0.0, None
    while True:
        above = F.col("w") * level >= F.col("cap")
        row = placed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("cap"))).alias("capped"),
            F.sum(F.when(~above, F.col("w"))).alias("free"),
        ).first()
        if not row["all"] or not row["free"] or row["free"] == left:
            break
        left = row["free"]
        level = (share * row["all"] - (row["capped"] or 0.0)) / left
    return placed.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def rates(sizes: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """sizes (doc_id, source, size, ...) with source_size, target and copies."""
    of = targets(sizes, **how).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    once = F.when(draw(F.col("doc_id"), seed) < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return (
        sizes.join(of, F.col("source").eqNullSafe(F.col("__source")), "left")
        .withColumn("__rate", rate)
        .withColumn("copies", (F.floor("__rate") + once).cast("long"))
        .drop("__source", "__rate")
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size of each row, kept apart from the texts."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    return stored(sized, "sizes")


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs as the mix takes them: repeated or left out, with docs' own columns.

    Only the small table of sources is joined to the texts; each text's size is not needed for that.
    """
    of = targets(measured(docs, id_col, text_col, source_col), **how)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = of.select(F.col("source").alias("__source"), rate.alias("__rate"))
    once = F.when(draw(F.col(id_col), seed) < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    taken = docs.join(of, F.col(source_col).eqNullSafe(F.col("__source")), "left").withColumn("__copies", F.coalesce((F.floor("__rate") + once).cast("int"), F.lit(0)))
    return taken.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
