"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without white space. Every step is a DataFrame operation.

* Step 1 counts the rows of each normalised length. A row whose length is its own can have no copy.
* Step 2 counts (length, hash of the first characters) among the rows left.
* Step 3 compares full SHA-256 digests of the rows left.

Each step reads only the columns that it needs from a slim table of signatures; texts are never
shuffled. A join key is a hash of the step's grouping key, so that both sides of the join are dealt
anew and Spark can split the partition of a hot key (equal texts in a third of all rows).

Defined results: a null text counts as empty; all empty texts are copies of each other. Among equal
texts the one with most code points in its original stays, then the smallest doc_id (null ids last).
Rows that repeat both the id and the text of the row that stays count as that row, unless row_col names
a column of row numbers: then of these the row with the least number is the one kept. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import stored, without_white

#: Characters whose hash splits the rows of one length.
PREFIX = 64


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_norm, prefix, text_sha256 of each row (and row); texts are read once and go no further."""
    row = [F.col(row_col).alias("row")] if row_col else []
    norm = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *row,
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        without_white(F.col(text_col)).alias("norm"),
    )
    return norm.select(
        "doc_id",
        *(["row"] if row_col else []),
        "n_chars",
        F.char_length("norm").cast("long").alias("n_norm"),
        F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def survivors(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose values of the columns by occur more than once."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    keys = groups.select(F.xxhash64(*by).alias("__key"))
    return rows.withColumn("__key", F.xxhash64(*by)).join(keys, "__key", "left_semi").drop("__key")


def exact_groups(signed: DataFrame) -> DataFrame:
    """text_sha256, keep_id, group_size (and keep_row) of each text that occurs more than once."""
    left = survivors(survivors(signed, "n_norm"), "n_norm", "prefix")
    row = [(-F.col("row")).alias("minus_row")] if "row" in signed.columns else []
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), *row))
    groups = left.groupBy("n_norm", "prefix", "text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    keep_row = [(-F.col("best.minus_row")).alias("keep_row")] if row else []
    return groups.where("group_size > 1").select("text_sha256", (-F.col("best.minus_id")).alias("keep_id"), "group_size", *keep_row)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (and row, if row_col is given)."""
    signed = stored(signatures(docs, id_col, text_col, row_col), "signatures")
    groups = exact_groups(signed).withColumn("grouped", F.lit(True))
    keep_id = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    kept = F.col("grouped").isNull() | (F.col("row") == F.col("keep_row")) if row_col else F.col("doc_id").eqNullSafe(keep_id)
    row = ["row"] if row_col else []
    return (
        signed.select("doc_id", *row, "text_sha256")
        .join(groups, "text_sha256", "left")
        .select(
            "doc_id",
            *row,
            keep_id.alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"),
            "text_sha256",
        )
    )
