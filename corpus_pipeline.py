"""A corpus pipeline: five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.llm.common import keyed, read, stored
from affinia.llm.exact_dedup import exact_dedup
from affinia.llm.jaccard import join_components
from affinia.llm.mixing import mix
from affinia.llm.pieces import digests
from affinia.llm.quality import select
from affinia.llm.queries import model_bytes


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the table of labels, doesn't reject."""
    return select(docs, read(spark, sf_dir, "labels"))


def _without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose numbers are in dropped, and without the numbers."""
    return docs.join(dropped, row, "left_anti").drop(row)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: decided by row, as ids may repeat or be null."""
    numbered, row = keyed(docs)
    dropped = exact_dedup(numbered, row_col=row).where("NOT kept").select(F.col("row").alias(row))
    return _without(numbered, row, stored(dropped, "copies"))


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each group that shares five-word shingles (Jaccard 0.8).

    Rows are compared under their numbers, so that texts with one id are not taken for one document.
    """
    numbered, row = keyed(docs)
    found = stored(join_components(numbered, width=5, percent=80, id_col=row).select(F.col("doc_id").alias(row), "component_id"), "near")
    ids = numbered.select(row, F.col("doc_id").cast("long").alias("__id"))
    first = F.min_by(row, F.struct(F.col("__id").isNull(), "__id", row))
    kept = found.join(ids, row).groupBy("component_id").agg(first.alias(row)).select(row)
    return _without(numbered, row, stored(found.select(row).join(kept, row, "left_anti"), "dropped"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources have their target weights."""
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return digests(docs, model_bytes())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_shingles),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
