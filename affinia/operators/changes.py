"""Upserts, replaced slices, decisions, staleness and change detection: tables in, tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.operators.ranking import first_per_group

STALE_DAYS = 45


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], update: bool = True) -> DataFrame:
    """old with new's rows: replacing rows with the same key, or only adding those that have none."""
    if update:
        return old.join(new, list(key), "left_anti").unionByName(new)
    return old.unionByName(new.join(old, list(key), "left_anti").select(*new.columns))


def slice_replaced(old: DataFrame, new: DataFrame, owner: Sequence[str], owners: DataFrame | None = None) -> DataFrame:
    """old without the rows of some owners (by default those in new), and with new's rows."""
    gone = (owners if owners is not None else new).select(*owner).distinct()
    return old.join(gone, list(owner), "left_anti").unionByName(new)


def latest(decisions: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last entry for each key."""
    return first_per_group(decisions, key, order)


def overlay(table: DataFrame, decisions: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """table with decided values over its own, and pending: whether they differ. decisions: key, decided."""
    joined = table.join(decisions, list(key), "left")
    value = F.coalesce("decided", column)
    return joined.withColumn("pending", ~value.eqNullSafe(F.col(column))).withColumn(column, value).drop("decided")


def is_before(a: Column, b: Column) -> Column:
    """Whether one text is an earlier instant than the other; one that can't be read is never before."""
    return F.coalesce(F.try_to_timestamp(a) < F.try_to_timestamp(b), F.lit(False))


def due(subjects: DataFrame, cursors: DataFrame, key: str, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Subjects without a cursor or with a stale one: never tried first, then the oldest attempt."""
    joined = subjects.join(cursors, key, "left")
    stale = F.col("fetched_at").isNull() | (F.col("fetched_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    return joined.where(stale).orderBy(F.asc_nulls_first("attempted_at"), F.asc(key))


def file_changes(listed: DataFrame, known: DataFrame) -> DataFrame:
    """path, change of a scan against what is known. listed: path, size, mtime, hash; known: the same."""
    b = known.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("hash").alias("h"))
    hashes = known.groupBy(F.col("hash").alias("kh")).agg(F.min("path").alias("other"))
    here = listed.select(F.col("path").alias("lp")).distinct()
    old_gone = hashes.join(here, F.col("other") == F.col("lp"), "left").select("kh", "other", F.col("lp").isNull().alias("gone"))
    both = listed.join(b, F.col("path") == F.col("p"), "full").join(old_gone, F.col("hash") == F.col("kh"), "left")
    change = (
        F.when(F.col("path").isNull(), "missing")
        .when(F.col("p").isNotNull() & (F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m")), "same")
        .when(F.col("p").isNotNull() & F.col("hash").eqNullSafe(F.col("h")), "touched")
        .when(F.col("p").isNotNull(), "changed")
        .when(F.col("other").isNotNull() & F.col("gone"), "moved")
        .when(F.col("other").isNotNull(), "copy")
        .otherwise("new")
    )
    return both.select(F.coalesce("path", "p").alias("path"), change.alias("change"))


def backoff_seconds(failures: Column) -> Column:
    """An hour, doubled with each failure, a day at most."""
    return F.least(F.lit(3600.0) * F.pow(F.lit(2.0), failures - 1), F.lit(86400.0)).cast("long")


def fetch_gate(max_failures: int = 3) -> Column:
    """What to do with a list: fetch, cached or stopped. Columns: retry, failures, stocked, stale, refetch."""
    return (
        F.when(~F.col("retry") & (F.col("failures") >= max_failures), "stopped")
        .when(F.col("refetch"), "fetch")
        .when(F.col("stocked") & ~F.col("stale"), "cached")
        .otherwise("fetch")
    )


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, digest: a SHA-256 over each group's rows in order, each value framed by its length. A gate for derived tables.

    A group's rows meet as their hashes, so by should split the table; `table_digest` puts the groups together.
    """
    framed = [F.concat(F.coalesce(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    hashed = df.select(*by, F.struct(*order, F.sha2(F.concat(*framed), 256).alias("__h")).alias("__row"))
    rows = F.transform(F.array_sort(F.collect_list("__row")), lambda r: r["__h"])
    return hashed.groupBy(*by).agg(F.sha2(F.array_join(rows, ""), 256).alias("digest"))


def table_digest(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """digest: one for a whole table, of its groups' digests in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*by, "digest"))), lambda r: r["digest"])
    return groups.agg(F.sha2(F.array_join(rows, ""), 256).alias("digest"))
