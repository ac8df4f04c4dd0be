"""Steps that keep a store up to date, as transforms of tables: what is due, what changed, what is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.ranking import first_per_group

#: Lists are kept with so many titles of the library at least.
LEAST_TITLES = 5


def claimed(listing: DataFrame) -> DataFrame:
    """listing with state: the least key that claims an item keeps it, others are forked under an id of their own.

    listing: rating_key, item_id (null where no id is known).
    """
    first = F.min("rating_key").over(Window.partitionBy("item_id"))
    own = F.concat(F.lit("plex:"), F.col("rating_key").cast("string"))
    known = listing.where("item_id IS NOT NULL").withColumn("__first", first)
    kept = F.col("rating_key") == F.col("__first")
    known = known.withColumn("state", F.when(kept, "kept").otherwise("forked")).withColumn("item_id", F.when(kept, F.col("item_id")).otherwise(own)).drop("__first")
    return known.unionByName(listing.where("item_id IS NULL").withColumn("item_id", own).withColumn("state", F.lit("new")))


def refreshed_edges(old: DataFrame, new: DataFrame, library: DataFrame, asked: DataFrame) -> DataFrame:
    """from_id, to_id, rank: old edges of titles that weren't asked for, and new ones within the library.

    Edges of a title to itself go; ranks keep the gaps of targets that go. asked: from_id; library: item_id.
    """
    kept = old.join(asked, "from_id", "left_anti")
    inside = new.where("from_id <> to_id").join(library.select(F.col("item_id").alias("to_id")), "to_id", "left_semi")
    return kept.unionByName(inside.select(*old.columns))


def merged_tags(entries: DataFrame) -> DataFrame:
    """title, tag, rank, spoiler: of several entries of a title the highest rank (nulls are no rank), and any spoiler."""
    return entries.groupBy("title", "tag").agg(F.max("rank").alias("rank"), F.bool_or("spoiler").alias("spoiler"))


def rating_facts(ratings: DataFrame) -> DataFrame:
    """item, key, value: each site's score, and its votes under a key of their own; nulls write nothing. ratings: item, site, score, votes."""
    facts = F.array(F.struct(F.col("site").alias("key"), F.col("score").cast("double").alias("value")), F.struct(F.concat("site", F.lit("_votes")).alias("key"), F.col("votes").cast("double").alias("value")))
    return ratings.select("item", F.explode(F.filter(facts, lambda x: x["value"].isNotNull())).alias("x")).select("item", "x.*")


def list_candidates(found: DataFrame, entries: DataFrame, library: DataFrame, rejected: DataFrame, least: int = LEAST_TITLES) -> DataFrame:
    """url, seeds, titles of lists to be harvested: found by the most seeds first. found: seed, url; entries: url, item; library: item; rejected: url."""
    seeds = found.join(rejected, "url", "left_anti").groupBy("url").agg(F.count_distinct("seed").alias("seeds"))
    titles = entries.join(library, "item", "left_semi").groupBy("url").agg(F.count_distinct("item").alias("titles")).where(F.col("titles") >= least)
    return seeds.join(titles, "url").orderBy(F.desc("seeds"), "url")


def kept_with(table: DataFrame, live: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key is still there: facts, frames and verdicts of what is gone are pruned."""
    return table.join(live.select(*key).distinct(), list(key), "left_semi")


def queued(queue: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """queue with what is asked for anew; what waits already keeps its place."""
    return queue.unionByName(asked.join(queue, key, "left_anti").select(*queue.columns))


def library_roles(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted with section: the first match by place among the kinds, or null. wanted: name; sections: name, kind, place, section."""
    best = sections.groupBy("name").agg(F.min_by("section", F.struct("place", "section")).alias("section"))
    return wanted.join(best, "name", "left")


def display_labels(forms: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """keyword, label: its own name, else the newest name in its group, else its readable form.

    forms: keyword, readable; names: keyword, name, decided_at; members: keyword, head.
    """
    grouped = forms.join(members, "keyword", "left").withColumn("head", F.coalesce("head", "keyword"))
    named = names.join(members, "keyword", "left").withColumn("head", F.coalesce("head", "keyword"))
    newest = named.groupBy("head").agg(F.max_by("name", F.struct("decided_at", "keyword")).alias("of_group"))
    own = names.select("keyword", F.col("name").alias("own"))
    joined = grouped.join(own, "keyword", "left").join(newest, "head", "left")
    of_group = F.when(F.col("head") == F.col("keyword"), F.col("of_group"))
    return joined.select("keyword", F.coalesce("own", of_group, "readable").alias("label"))


def not_judged(pairs: DataFrame, judged: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs that have no answer of any kind yet: each is asked about once."""
    return pairs.join(judged, list(key), "left_anti")


def changed_since(listed: DataFrame, stored: DataFrame, key: str, stamp: str) -> DataFrame:
    """key, why of what has to be fetched or removed: new, changed (another stamp), gone."""
    a, b = listed.select(key, F.col(stamp).alias("__now"), F.lit(1).alias("__a")), stored.select(key, F.col(stamp).alias("__then"), F.lit(1).alias("__b"))
    why = F.when(F.col("__a").isNull(), "gone").when(F.col("__b").isNull(), "new").when(~F.col("__now").eqNullSafe(F.col("__then")), "changed")
    return a.join(b, key, "full").select(key, why.alias("why")).where("why IS NOT NULL")


def rekeyed(table: DataFrame, mapping: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """table with old keys replaced; of rows that then have one identity, the one that had its key already stays. mapping: old, new."""
    moved = table.join(mapping.select(F.col("old").alias(key), "new"), key, "left").withColumn("__moved", F.col("new").isNotNull())
    moved = moved.withColumn("__was", F.col(key)).withColumn(key, F.coalesce("new", key)).drop("new")
    return first_per_group(moved, identity, [F.asc("__moved"), F.asc("__was")]).select(*table.columns)


def outcome(retry_hours: Column) -> Column:
    """What to do with a file: columns state, size, seen_size, hours (since the last try). A settled state holds while the size does."""
    settled = F.col("state").isin("done", "failed", "excluded")
    return (
        F.when(F.col("state").isNull(), "try")
        .when(settled & F.col("size").eqNullSafe(F.col("seen_size")), F.col("state"))
        .when((F.col("state") == "unreachable") & (F.col("hours") < retry_hours), "wait")
        .otherwise("try")
    )


def first_phase(phases: Sequence[DataFrame], key: str) -> DataFrame:
    """key, phase: the first of several ordered work lists in which each subject stands."""
    out = None
    for k, df in enumerate(phases):
        one = df.select(key, F.lit(k).alias("phase"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min("phase").alias("phase"))


def labelled_cells(cells: DataFrame, labels: DataFrame, prefixes: Sequence[str] = ("imdb", "tmdb", "tvdb", "plex", "fs")) -> DataFrame:
    """cell, label of the distinct cells that look like ids. labels: id, label."""
    ids = cells.where(F.col("cell").rlike(f"^({'|'.join(prefixes)}):")).select("cell").distinct()
    return ids.join(labels, F.col("cell") == F.col("id"), "left").select("cell", "label")


def file_reasons(files: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """path, reasons: what a file's header lacks. files: path, video, audio, duration, expected."""
    off = F.abs(F.col("duration") - F.col("expected")) > F.lit(tolerance) * F.col("expected")
    reasons = F.array_compact(F.array(F.when(F.col("video") == 0, "no video"), F.when(F.col("audio") == 0, "no audio"), F.when(off, "duration")))
    return files.select("path", reasons.alias("reasons")).where(F.size("reasons") > 0)


def list_totals(lists: DataFrame, entries: DataFrame, owned: DataFrame) -> DataFrame:
    """source, lists, entries, owned, failures. lists: list, source, failures; entries: list, item; owned: item."""
    counted = entries.join(owned.withColumn("__own", F.lit(1)), "item", "left").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count("__own").alias("own"))
    joined = lists.join(counted, "list", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("lists"), total("n").alias("entries"), total("own").alias("owned"), F.count(F.when(F.col("failures") > 0, 1)).alias("failures"))


def health(checks: dict[str, DataFrame]) -> DataFrame:
    """name, n: how many rows each check finds."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def once_ingested(plays: DataFrame, new: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plays to be added, those that wait for their item, and cursor: the time from which to ask again.

    Events without an item hold the cursor at the oldest of them, so that they are asked for again.
    plays: history_key; new: history_key, rating_key, viewed_at; identities: rating_key, item_id.
    """
    fresh = new.dropDuplicates(["history_key"]).join(plays, "history_key", "left_anti").join(identities, "rating_key", "left")
    waiting = fresh.where("item_id IS NULL")
    cursor = fresh.agg(F.coalesce(F.min(F.when(F.col("item_id").isNull(), F.col("viewed_at"))), F.max("viewed_at")).alias("since"))
    return fresh.where("item_id IS NOT NULL"), waiting, cursor


def synonym_pairs(nearest: DataFrame, judged: DataFrame, least: float) -> DataFrame:
    """a, b, score: near keywords to be judged, each pair once. nearest: id, other, cosine; judged: a, b."""
    pairs = nearest.where(F.col("cosine") >= least).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.col("cosine").alias("score"))
    return not_judged(pairs.groupBy("a", "b").agg(F.max("score").alias("score")), judged, ["a", "b"])


def unit_square(points: DataFrame) -> DataFrame:
    """points (id, x, y) in the unit square, with one factor for both axes; points that are all alike go to 0."""
    ends = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("width"))
    of = lambda c: F.when(F.col("width") > 0, (F.col(c) - F.col(f"{c}0")) / F.col("width")).otherwise(0.0).alias(c)
    return points.crossJoin(F.broadcast(ends)).select("id", of("x"), of("y"))  # one row


def language_facts(items: DataFrame, languages: DataFrame) -> DataFrame:
    """item_id, language: one row of each item whose language is known; an episode has its show's.

    items: item_id, show_item_id (null but for episodes); languages: item_id, language.
    """
    owner = items.select("item_id", F.coalesce("show_item_id", "item_id").alias("owner"))
    known = languages.where("language IS NOT NULL").groupBy(F.col("item_id").alias("owner")).agg(F.min("language").alias("language"))
    return owner.join(known, "owner").select("item_id", "language")


def harvested(old: DataFrame, new: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """old with the rows of items that were harvested replaced by the new ones; an item that failed keeps its rows.

    outcomes: key, ok.
    """
    done = outcomes.where("ok").select(key).distinct()
    return old.join(done, key, "left_anti").unionByName(new.join(done, key, "left_semi"))


def imported(known: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with a key that isn't known yet the first one of each key; rows without a key are left out."""
    named = rows.dropna(subset=list(key))
    return first_per_group(named.join(known.select(*key), list(key), "left_anti"), key, order)
