"""Answers of other systems that lie in a table, one JSON text in each row of its column body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANIME = "data struct<Page: struct<media: array<struct<id: bigint, tags: array<struct<name: string, category: string, rank: bigint, isGeneralSpoiler: boolean, isMediaSpoiler: boolean>>>>>>"
RATED = "ratings array<struct<source: string, value: double, score: double, votes: bigint>>"
DETAILS = "id bigint, original_language string, release_date string, first_air_date string"


def anime_tags(answers: DataFrame) -> DataFrame:
    """entry, tag, category, rank, spoiler of each tag; a body that isn't JSON, or has no media, gives no row."""
    media = answers.select(F.explode(F.from_json("body", ANIME)["data"]["Page"]["media"]).alias("m"))
    tags = media.select(F.col("m.id").alias("entry"), F.explode("m.tags").alias("t"))
    spoiler = F.coalesce("t.isGeneralSpoiler", F.lit(False)) | F.coalesce("t.isMediaSpoiler", F.lit(False))
    return tags.select("entry", F.col("t.name").alias("tag"), "t.category", "t.rank", spoiler.alias("spoiler"))


def site_ratings(answers: DataFrame, key: str) -> DataFrame:
    """key, site, score, votes of each rating with a score or votes."""
    each = answers.select(key, F.explode(F.from_json("body", RATED)["ratings"]).alias("r"))
    return each.select(key, F.col("r.source").alias("site"), "r.score", "r.votes").where("score IS NOT NULL OR votes IS NOT NULL")


def details(answers: DataFrame) -> DataFrame:
    """id, language, year of films (release_date) and shows (first_air_date)."""
    d = answers.select(F.from_json("body", DETAILS).alias("d")).select("d.*").where("id IS NOT NULL")
    date = F.coalesce(F.nullif("release_date", F.lit("")), "first_air_date")
    return d.select("id", F.col("original_language").alias("language"), F.regexp_extract(date, r"^(\d{4})-", 1).try_cast("int").alias("year"))


def ndjson(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """place, line: the rows of some stages as JSON lines, then one line that says it is done."""
    spark = stages[0][1].sparkSession
    lines = [rows.select(F.lit(k).alias("place"), F.to_json(F.struct(F.lit(name).alias("stage"), "*"), {"ignoreNullFields": "false"}).alias("line")) for k, (name, rows) in enumerate(stages)]
    lines.append(spark.range(1).select(F.lit(len(stages)).alias("place"), F.to_json(F.struct(F.lit("done").alias("stage"))).alias("line")))
    out = lines[0]
    for more in lines[1:]:
        out = out.unionAll(more)
    return out


HISTORY = "MediaContainer struct<Metadata: array<struct<historyKey: string, ratingKey: string, viewedAt: bigint, accountID: bigint, deviceID: string, type: string>>>"
LISTING = "MediaContainer struct<Metadata: array<struct<ratingKey: string, type: string, title: string, year: bigint, grandparentTitle: string, parentIndex: bigint, Guid: array<struct<id: string>>, Media: array<struct<Part: array<struct<file: string>>>>>>>"
RELATED = "results array<struct<id: bigint, media_type: string>>"
LIST_ITEMS = "movies array<struct<imdb_id: string, title: string, rank: bigint>>, shows array<struct<imdb_id: string, title: string, rank: bigint>>"
BINDINGS = "results struct<bindings: array<struct<imdb: struct<value: string>, prop: struct<value: string>, label: struct<value: string>>>>"


def history(answers: DataFrame) -> DataFrame:
    """history_key, rating_key, account_id, device_id, viewed_at, type of each event of paged answers."""
    m = answers.select(F.explode(F.from_json("body", HISTORY)["MediaContainer"]["Metadata"]).alias("m"))
    return m.select(F.col("m.historyKey").alias("history_key"), F.col("m.ratingKey").alias("rating_key"), F.col("m.accountID").alias("account_id"), F.col("m.deviceID").alias("device_id"), F.col("m.viewedAt").alias("viewed_at"), F.col("m.type").alias("type"))


def listing(answers: DataFrame) -> DataFrame:
    """rating_key, type, title, year, show, season, namespace, value, file of each title: its first id and first file, null without."""
    m = answers.select(F.explode(F.from_json("body", LISTING)["MediaContainer"]["Metadata"]).alias("m")).select("m.*")
    first = F.get("Guid", F.lit(0))["id"]
    file = F.get(F.get("Media", F.lit(0))["Part"], F.lit(0))["file"]
    id_ = lambda k: F.when(F.contains(first, F.lit("://")), F.split_part(first, F.lit("://"), F.lit(k)))
    return m.select(F.col("ratingKey").alias("rating_key"), "type", "title", "year", F.col("grandparentTitle").alias("show"), F.col("parentIndex").alias("season"), id_(1).alias("namespace"), id_(2).alias("value"), file.alias("file"))


def related(answers: DataFrame) -> DataFrame:
    """from_id, to_id, rank (the place in the answer, from 1), kind. answers: from_id, body."""
    r = answers.select("from_id", F.posexplode(F.from_json("body", RELATED)["results"]).alias("at", "r"))
    return r.select("from_id", F.col("r.id").alias("to_id"), (F.col("at") + 1).cast("long").alias("rank"), F.col("r.media_type").alias("kind"))


def list_entries(answers: DataFrame) -> DataFrame:
    """list, kind, imdb_id, title, rank of a list's films and shows. answers: list, body."""
    both = answers.select("list", F.from_json("body", LIST_ITEMS).alias("b"))

    def of(kind: str, column: str) -> Column:
        return F.transform(f"b.{column}", lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("e")))

    kinds = F.array(of("movie", "movies"), of("show", "shows"))
    each = both.select("list", F.explode(F.flatten(F.filter(kinds, lambda x: x.isNotNull()))).alias("x"))
    return each.select("list", "x.kind", "x.e.imdb_id", "x.e.title", "x.e.rank")


def statements(answers: DataFrame) -> DataFrame:
    """imdb, property, label of each binding."""
    b = answers.select(F.explode(F.from_json("body", BINDINGS)["results"]["bindings"]).alias("b"))
    return b.select(F.col("b.imdb.value").alias("imdb"), F.col("b.prop.value").alias("property"), F.col("b.label.value").alias("label"))
