"""Recorded answers of other systems as tables. Schemas are declared; positions become ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "MediaContainer struct<Metadata: array<struct<historyKey: string, ratingKey: string, viewedAt: bigint, accountID: bigint, deviceID: bigint, type: string, title: string>>>"
LISTING = "MediaContainer struct<Metadata: array<struct<ratingKey: string, type: string, title: string, titleSort: string, year: bigint, duration: bigint, grandparentRatingKey: string, grandparentTitle: string, parentIndex: bigint, index: bigint, Guid: array<struct<id: string>>, Media: array<struct<Part: array<struct<file: string>>>>>>>"
SECOND_HISTORY = "response struct<data: struct<data: array<struct<id: bigint, started: bigint, stopped: bigint, duration: bigint, user_id: bigint, platform: string, ip_address: string, machine_id: string, rating_key: bigint, percent_complete: bigint>>>>"
RELATED = "id bigint, results array<struct<id: bigint, title: string, media_type: string>>"
KEYWORDS = "id bigint, keywords array<struct<id: bigint, name: string>>, results array<struct<id: bigint, name: string>>"
LIST_ITEMS = "movies array<struct<id: bigint, imdb_id: string, title: string, release_year: bigint, rank: bigint>>, shows array<struct<id: bigint, imdb_id: string, tvdb_id: bigint, title: string, release_year: bigint, rank: bigint>>"
BINDINGS = "results struct<bindings: array<struct<imdb: struct<value: string>, prop: struct<value: string>, label: struct<value: string>>>>"


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, HISTORY).select(F.explode("MediaContainer.Metadata").alias("m"))
    return rows.select(F.col("m.historyKey").alias("history_key"), F.col("m.ratingKey").alias("rating_key"), F.col("m.accountID").alias("account_id"), F.col("m.deviceID").cast("string").alias("device_id"), F.col("m.viewedAt").alias("viewed_at"), F.col("m.type").alias("type"))


def finished_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the second history; those without an id are still running and left out."""
    rows = _json(spark, path, SECOND_HISTORY).select(F.explode("response.data.data").alias("m")).select("m.*")
    return rows.where("id IS NOT NULL")


def listing(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, LISTING).select(F.explode("MediaContainer.Metadata").alias("m")).select("m.*")


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """title, keyword, rank: films answer under keywords, shows under results; an empty answer has no rows."""
    both = _json(spark, path, KEYWORDS).select("id", F.posexplode(F.coalesce("keywords", "results")).alias("at", "k"))
    return both.select(F.col("id").alias("title"), F.col("k.name").alias("keyword"), (F.col("at") + 1).alias("rank"))


def related(spark: SparkSession, path: str, title: int) -> DataFrame:
    rows = _json(spark, path, RELATED).select(F.posexplode("results").alias("at", "r"))
    return rows.select(F.lit(title).alias("from_id"), F.col("r.id").alias("to_id"), (F.col("at") + 1).alias("rank"))


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """kind, imdb_id, title, rank of a list's films and shows."""
    raw = _json(spark, path, LIST_ITEMS)
    kinds = [raw.select(F.lit(kind).alias("kind"), F.explode(col).alias("e")).select("kind", "e.imdb_id", "e.title", "e.rank") for kind, col in (("movie", "movies"), ("show", "shows"))]
    return kinds[0].unionByName(kinds[1])


def statements(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, BINDINGS).select(F.explode("results.bindings").alias("b"))
    return rows.select(F.col("b.imdb.value").alias("imdb"), F.col("b.prop.value").alias("property"), F.col("b.label.value").alias("label"))
