"""Filters of the store's calls: optional arguments, escaped text, existence, and files that count as a whole."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, **equal) -> DataFrame:
    """A filter for each argument that isn't None."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def containing(column: Column, text: str) -> Column:
    """Whether a column has a text in it, A-Z like a-z; %, _ and \\ stand for themselves."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.contains(F.translate(column, upper, lower), F.lit(text.translate(str.maketrans(upper, lower))))


def existing(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """wanted with found: whether the table has a row of the key; a null key is never found."""
    keys = table.select(key).distinct().withColumn("__is", F.lit(True))
    return wanted.join(keys, key, "left").withColumn("found", F.coalesce("__is", F.lit(False))).drop("__is")


def whole_files(rows: DataFrame, file: str, valid: Column) -> DataFrame:
    """The rows of files that have no invalid row: a file is taken as a whole or not at all. An unknown validity is invalid."""
    bad = rows.where(~F.coalesce(valid, F.lit(False))).select(file).distinct()
    return rows.join(bad, rows[file].eqNullSafe(bad[file]), "left_anti")


def hiding(rows: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """rows without columns that readers mustn't see; naming one that isn't there is an error."""
    missing = set(hidden) - set(rows.columns)
    if missing:
        raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
    return rows.drop(*hidden)
