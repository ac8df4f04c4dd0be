"""Top-k per group, pages, first occurrences and latest rows: every order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.shared import stored


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group with their place (from 1). Spark drops others before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, place.cast("long")).where(F.col(name) <= n)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, by, order, 1, "__place").drop("__place")


def placed_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], place: str = "place", size: str = "size") -> DataFrame:
    """df with each row's place (from 0) in its group's order, and the group's size, for groups of any size.

    Rows are dealt by range of group and order, so that a large group is in several tasks. They are numbered
    within their part, and shifted by the sizes of the group's parts before.
    """
    dealt = stored(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(parts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"), F.sum("__n").over(whole).alias(size)), "shift")
    inside = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    numbered = dealt.withColumn("__inside", inside).join(shift, [*by, "__part"])
    return numbered.withColumn(place, (F.col("__shift") + F.col("__inside") - 1).cast("long")).drop("__part", "__inside", "__shift")


def page(df: DataFrame, key: Sequence[str], after: Sequence | None = None, limit: int = 100) -> DataFrame:
    """Up to limit + 1 rows behind a key, in key order: the further row says that there is more."""
    if after is not None:
        pair = F.struct(*key), F.struct(*[F.lit(v).alias(k) for k, v in zip(key, after, strict=True)])
        df = df.where(pair[0] > pair[1])
    return df.orderBy(*key).limit(limit + 1)


def capped(df: DataFrame, order: Sequence[Column], limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first rows, and a row that says whether there were more."""
    some = df.orderBy(*order).limit(limit + 1)
    return some.limit(limit), some.agg((F.count(F.lit(1)) > limit).alias("truncated"))


def prefix_first(df: DataFrame, column: str, query: str, *then: Column) -> DataFrame:
    """Rows that contain query: equal ones first, then those that start with it, then the others."""
    value, q = F.lower(F.col(column)), query.lower()
    found = df.where(F.contains(value, F.lit(q)))
    return found.orderBy((value != q), ~F.startswith(value, F.lit(q)), *then)


def spread_picks(items: Column, n: int) -> Column:
    """n elements of an array, evenly spread, with half positions rounded to even."""
    size = F.size(items)
    at = F.sequence(F.lit(0), F.lit(n - 1))
    step = (size - 1) / F.lit(max(n - 1, 1))
    return F.when(size <= n, items).otherwise(F.transform(at, lambda i: F.get(items, F.bround(i * step).cast("int"))))


def primary_file(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each group the file that is there, then the highest, the largest, and the first path (unknown sizes last)."""
    return first_per_group(files, by, [F.desc(F.coalesce("present", F.lit(False))), F.desc_nulls_last("height"), F.desc_nulls_last("size"), F.asc("path")])
