"""Named queries to start from, over the tables of a store. Each takes a function that gives a table by its name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]
RECIPES: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def recipe(group: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        RECIPES[f.__name__] = group, f
        return f

    return add


def _titled(rows: DataFrame, t: Tables, key: str, prefix: str) -> DataFrame:
    """rows with the title and year of the item in a column; an id that isn't there has none."""
    named = t("items").select(F.col("item_id").alias(key), F.col("title").alias(f"{prefix}title"), F.col("year").alias(f"{prefix}year"))
    return rows.join(named, key, "left")


def _units(t: Tables) -> DataFrame:
    items = t("items").select("item_id", F.coalesce("show_item_id", "item_id").alias("unit"))
    return t("plays").join(items, "item_id").select("account_id", "unit")


@recipe("overview")
def rows_per_table(t: Tables, names: Sequence[str] = ("items", "plays", "enrichment", "edges", "collection", "collection_membership")) -> DataFrame:
    counts = [t(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@recipe("overview")
def titles_per_type(t: Tables) -> DataFrame:
    return t("items").groupBy("type").agg(F.count(F.lit(1)).alias("titles")).orderBy(F.desc("titles"), "type")


@recipe("overview")
def keys_per_namespace(t: Tables, most: int = 50) -> DataFrame:
    found = t("enrichment").groupBy("namespace", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("titles"), F.count_distinct("value").alias("values"))
    return found.orderBy(F.desc("n"), "namespace", "key").limit(most)


@recipe("overview")
def plays_per_account(t: Tables) -> DataFrame:
    found = t("plays").groupBy("account_id").agg(F.count(F.lit(1)).alias("plays"), F.min("viewed_at").alias("first"), F.max("viewed_at").alias("last"))
    return found.orderBy(F.desc("plays"), "account_id")


@recipe("titles")
def facts_of(t: Tables, ids: Sequence[str], namespace: str) -> DataFrame:
    rows = t("enrichment").where(F.col("item_id").isin(*ids) & (F.col("namespace") == namespace))
    return _titled(rows.select("item_id", "namespace", "key", "value"), t, "item_id", "").orderBy("item_id", "key", "value")


@recipe("titles")
def attributes_of(t: Tables, item_id: str) -> DataFrame:
    rows = t("enrichment").where(F.col("item_id") == item_id).select("item_id", "namespace", "key", "value").distinct()
    return _titled(rows, t, "item_id", "").orderBy("namespace", "key", "value")


@recipe("titles")
def edges_of(t: Tables, item_id: str, edge_type: str, inward: bool = False) -> DataFrame:
    end = "to_id" if inward else "from_id"
    rows = t("edges").where((F.col(end) == item_id) & (F.col("edge_type") == edge_type)).select("from_id", "to_id", "rank")
    return _titled(_titled(rows, t, "from_id", "from_"), t, "to_id", "to_").orderBy("rank", "from_id", "to_id")


@recipe("titles")
def collections_of(t: Tables, item_id: str) -> DataFrame:
    mine = t("collection_membership").where(F.col("item_id") == item_id)
    return mine.join(t("collection"), "collection_id").select("collection_id", "name", "likes", "rank").orderBy("collection_id")


@recipe("accounts")
def units_of(t: Tables, account: int) -> DataFrame:
    """Plays of one account by unit."""
    counted = _units(t).where(F.col("account_id") == account).groupBy("unit").agg(F.count(F.lit(1)).alias("plays"))
    return _titled(counted, t, "unit", "").orderBy("unit")


@recipe("accounts")
def watched_by(t: Tables, account: int | None = None) -> DataFrame:
    """The units that one account has played, or any."""
    rows = _units(t) if account is None else _units(t).where(F.col("account_id") == account)
    return _titled(rows.select("unit").distinct(), t, "unit", "").orderBy("unit")


@recipe("accounts")
def pooled_units(t: Tables) -> DataFrame:
    counted = _units(t).groupBy("unit").agg(F.count(F.lit(1)).alias("plays"))
    return _titled(counted, t, "unit", "").orderBy(F.desc("plays"), "unit")


@recipe("accounts")
def season_sizes(t: Tables) -> DataFrame:
    seasons = t("items").where("type = 'episode' AND show_item_id IS NOT NULL AND season IS NOT NULL").groupBy("show_item_id", "season").agg(F.count(F.lit(1)).alias("episodes"))
    return seasons.join(t("items").select(F.col("item_id").alias("show_item_id"), "title"), "show_item_id", "left").orderBy("show_item_id", "episodes", "season")
