"""The typed calls of a store: each gives a DataFrame; pages are by key and ask for one row more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.operators import clusters, filters, matching, ranking, tags, taste, vectors
from affinia.sources.store import Store

LIMIT, MOST = 100, 1000


class Api:
    """Calls on one version of a store."""

    def __init__(self, store: Store, version: int | None = None):
        self.store = store
        self.version = store.versions()[-1] if version is None else version

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name, self.version)

    def _among(self, df: DataFrame, ids: Sequence[str] | None) -> DataFrame:
        """Rows of the given items: a semi join with the list of ids, whatever its length."""
        if ids is None:
            return df
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "item_id string")
        return df.join(wanted, "item_id", "left_semi")

    def _page(self, df: DataFrame, key: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
        if not 1 <= limit <= MOST:
            raise ValueError(f"a page has 1 to {MOST} rows")
        return ranking.page(df, key, after, limit)

    # --- items and what belongs to them

    def items(self, type: str | None = None, library: str | None = None, show: str | None = None, after: str | None = None, limit: int = LIMIT, include: Sequence[str] = (), namespace: str | None = None) -> DataFrame:
        """A page of items; include attaches enrichment, external_ids or media_parts as lists."""
        page = self._page(filters.only(self._t("items"), type=type, library=library, show_item_id=show), ["item_id"], None if after is None else [after], limit)
        for name in include:
            rows = self.enrichment(namespace=namespace) if name == "enrichment" else self._t(name)
            kept = [c for c in rows.columns if c != "item_id"]
            lists = rows.join(page.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias(name))
            page = page.join(lists, "item_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
        return page

    def item(self, item_id: str) -> DataFrame:
        return self._t("items").where(F.col("item_id") == item_id).limit(1)

    def exists(self, item_id: str) -> bool:
        return not self._t("items").where(F.col("item_id") == item_id).isEmpty()

    def enrichment(self, ids: Sequence[str] | None = None, namespace: str | None = None, key: str | None = None) -> DataFrame:
        """One row for each fact, whatever its sources, with the newest instant."""
        facts = self._among(filters.only(self._t("enrichment"), namespace=namespace, key=key), ids)
        return facts.groupBy("item_id", "namespace", "key", "value").agg(F.max("fetched_at").alias("fetched_at"))

    def edges(self, item_id: str, type: str | None = None, direction: str = "from") -> DataFrame:
        here, there = ("from_id", "to_id") if direction == "from" else ("to_id", "from_id")
        rows = filters.only(self._t("edges").where(F.col(here) == item_id), edge_type=type)
        return rows.select(F.col(there).alias("item_id"), "edge_type", "rank").orderBy("edge_type", F.asc_nulls_last("rank"), "item_id")

    def collections(self, item_id: str) -> DataFrame:
        mine = self._t("collection_membership").where(F.col("item_id") == item_id)
        return mine.join(self._t("collection"), "collection_id").orderBy(F.desc_nulls_last("likes"), "collection_id")

    def audio_facts(self, ids: Sequence[str] | None = None) -> DataFrame:
        """The facts of each item's highest part that is there."""
        parts = self._among(self._t("media_part").where("present"), ids).join(self._t("audio_facts"), "file_hash")
        best = parts.groupBy("item_id").agg(F.min_by("facts", F.struct((-F.coalesce("height", F.lit(0))).alias("h"), (-F.coalesce("size", F.lit(0))).alias("s"), "part_id")).alias("facts"))
        return best

    def external_ids(self, ids: Sequence[str] | None = None, namespace: str | None = None) -> DataFrame:
        return self._among(filters.only(self._t("external_ids"), namespace=namespace), ids)

    def plex(self, ids: Sequence[str] | None = None) -> DataFrame:
        return self._among(self._t("plex_items"), ids)

    def media_parts(self, ids: Sequence[str] | None = None) -> DataFrame:
        return self._among(self._t("media_part"), ids)

    def cuts(self, item_id: str) -> DataFrame:
        return self._t("cuts").where(F.col("item_id") == item_id).orderBy("t_ms")

    # --- plays and accounts

    def plays(self, account: int | None = None, since: int | None = None, after: str | None = None, limit: int = LIMIT) -> DataFrame:
        """A page of plays, without addresses, devices and keys of other systems."""
        rows = filters.only(self._t("plays"), account_id=account)
        if since is not None:
            rows = rows.where(F.col("viewed_at") >= since)
        return self._page(rows.select("history_key", "item_id", "account_id", "viewed_at", "seconds_watched"), ["history_key"], None if after is None else [after], limit)

    def accounts(self) -> DataFrame:
        return self._t("plays").groupBy("account_id").agg(F.count(F.lit(1)).alias("plays"), F.max("viewed_at").alias("last_viewed_at"))

    def _units(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        items = self._t("items").select("item_id", "type", F.coalesce("show_item_id", "item_id").alias("unit"), "season")
        plays = self._t("plays").join(items, "item_id").select(F.col("account_id").alias("account"), "unit")
        episodes = items.where("type = 'episode'").select("unit", "season", F.col("item_id").alias("episode"))
        facts = self._t("enrichment").select(F.col("item_id").alias("unit"), "namespace", "key", "value").distinct()
        return plays, episodes, facts

    def taste(self, account: int | None = None) -> DataFrame:
        """Of one account, or with none of the whole house."""
        plays, episodes, facts = self._units()
        if account is None:
            return taste.pooled_taste(plays, episodes, facts).orderBy("namespace", "key", "value")
        return taste.taste(filters.only(plays, account=account), episodes, facts).drop("account").orderBy("namespace", "key", "value")

    def watched(self, account: int | None = None) -> DataFrame:
        plays, episodes, _ = self._units()
        units = taste.watched_units(filters.only(plays, account=account), taste.season_lengths(episodes))
        return units.select("unit").distinct().orderBy("unit")

    # --- keywords

    def keywords(self, surface: str | None = None) -> DataFrame:
        return filters.only(self._t("keyword_forms"), surface=surface).select("keyword").union(self._t("keyword_names").select("keyword") if surface is None else self._t("keyword_names").limit(0).select("keyword")).distinct()

    def keyword(self, keyword: str) -> DataFrame:
        """Its spellings, its readable form, and its own name if it has one."""
        forms = self._t("keyword_forms").where(F.col("keyword") == keyword)
        spelled = forms.groupBy("keyword").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"), F.min_by("surface", F.struct(F.char_length("surface"), "surface")).alias("readable"))
        return spelled.join(self._t("keyword_names").select("keyword", "name"), "keyword", "left")

    def pairs(self, keyword: str | None = None, decision: str | None = None) -> DataFrame:
        """decision: accepted, rejected or undecided."""
        rows = self._t("keyword_pairs")
        if decision == "undecided":
            rows = rows.where(F.col("decision").isNull())
        elif decision is not None:
            rows = rows.where(F.col("decision") == decision)
        return rows if keyword is None else matching.either_end(rows, keyword)

    def roles(self, keyword: str) -> DataFrame:
        return self._t("keyword_roles").where(F.col("keyword") == keyword).orderBy(F.desc("score"), "role")

    def merges(self) -> DataFrame:
        facts = self._t("enrichment").where("key = 'keyword'").groupBy(F.col("value").alias("keyword")).agg(F.count_distinct("item_id").alias("titles"))
        return clusters.merge_map(self._t("keyword_pairs").select("a", "b", "score", "decision"), facts)

    def neighbours(self, tag: str, kind: str) -> DataFrame:
        """other, shared, df of a tag among the titles of a kind."""
        titles = self._t("items").where(F.col("type") == kind).select(F.col("item_id").alias("title"))
        tagged = self._t("enrichment").where("key = 'keyword'").select(F.col("item_id").alias("title"), F.col("value").alias("tag")).distinct()
        return tags.co_tags(tagged.join(titles, "title", "left_semi"), tag)

    # --- vectors

    def search(self, phrase: Sequence[float], pool: Sequence[str] | None = None, negatives: Sequence[Sequence[float]] = (), weight: float = 0.5, temperature: float | None = None, draw: int | None = None, seed: int = 0) -> DataFrame:
        """Shots by score; with a temperature their probabilities, with draw a seeded sample."""
        frames = self._among(self._t("frames"), pool)
        models = [r.model for r in frames.select("model").distinct().limit(2).collect()]
        if len(models) > 1:
            raise ValueError(f"vectors of several models: {', '.join(sorted(map(str, models)))}")
        scored = vectors.shot_scores(frames.select(F.col("item_id").alias("item"), "shot", "t_ms", "vector"), phrase, negatives, weight)
        if draw is not None and temperature:
            return vectors.draw(scored, draw, seed, temperature, ["item", "shot"])
        if temperature:
            scored = vectors.softmax(scored, temperature)
        ordered = scored.orderBy(F.desc("score"), "item", "shot")
        return ordered if draw is None else ordered.limit(draw)

    def capabilities(self) -> dict:
        return self.store.check_shape(self.version)


def as_json(rows: DataFrame) -> DataFrame:
    """value: each row as a JSON text; nulls are written."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def freshness(rows: DataFrame, stamp: str, now: Column, days: int = 3) -> DataFrame:
    last = F.max(stamp)
    return rows.agg(last.alias("last"), F.date_diff(now, last).alias("days"), (F.date_diff(now, last) > days).alias("stale"))
