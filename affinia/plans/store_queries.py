"""Queries of the store's filters, sources, sinks and writers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinia.functions import text as T
from affinia.operators import filters, ranking, upkeep, vectors
from affinia.plans.api import as_json
from affinia.plans.catalogue import query
from affinia.plans.upkeep_queries import ORACLES, QUERIES
from affinia.sources import answers

__all__ = ["ORACLES", "QUERIES"]


@query("existence_probe", "SELECT l_partkey AS p_partkey, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AS found FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def _(t):
    return filters.existing(t("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct(), t("part").where("p_size > 20"), "p_partkey")


@query("optional_filters", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#1'")
def _(t):
    return filters.only(t("part").select("p_partkey", "p_brand", "p_size"), p_brand="Brand#1", p_size=None)


@query("escaped_search", """
WITH n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '_5%' ELSE p_name || 'x5y' END || p_brand AS name FROM part)
SELECT p_partkey, name FROM n WHERE name ILIKE '%\\_5\\%BRAND#%' ESCAPE '\\'""")
def _(t):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "_5%").otherwise("x5y"), "p_brand")
    return t("part").select("p_partkey", name.alias("name")).where(filters.containing(F.col("name"), "_5%BRAND#"))


@query("plays_since", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    rows = t("events").select("event_id", "user_id", "event_type", "ts", "value").where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return filters.hiding(rows, ["ts", "value"])


@query("rollup_keys", "SELECT unit, count(*) AS n FROM (SELECT coalesce(CASE WHEN p_size < 40 THEN p_brand END, p_name) AS unit FROM part) GROUP BY unit")
def _(t):
    unit = F.coalesce(F.when(F.col("p_size") < 40, F.col("p_brand")), F.col("p_name"))
    return t("part").groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query("whole_files", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return filters.whole_files(lines, "l_orderkey", F.col("l_quantity") <= 45).select("l_orderkey", "l_linenumber")


@query("imported_facts", """
WITH f AS (SELECT p_name || '/' || p_partkey % 20 AS hash, p_partkey AS fact, p_size FROM part)
SELECT hash, fact FROM f WHERE hash NOT IN (SELECT hash FROM f WHERE p_size < 5) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY fact) = 1""")
def _(t):
    hash_ = F.concat_ws("/", "p_name", (F.col("p_partkey") % 20).cast("string"))
    rows = t("part").select(hash_.alias("hash"), F.col("p_partkey").alias("fact"), "p_size")
    return upkeep.imported(rows.where("p_size < 5"), rows.drop("p_size"), ["hash"], [F.asc("fact")])


@query("stage_lines", """
SELECT 0 AS place, CAST(to_json({'stage': 'vocab', 'region': r_regionkey, 'name': r_name}) AS VARCHAR) AS line FROM region
UNION ALL SELECT 1, CAST(to_json({'stage': 'edges', 'nation': n_nationkey, 'region': CASE WHEN n_nationkey > 3 THEN n_regionkey END}) AS VARCHAR) FROM nation UNION ALL SELECT 2, '{"stage":"done"}'""")
def _(t):
    vocab = t("region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    edges = t("nation").select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") > 3, F.col("n_regionkey")).alias("region"))
    return answers.ndjson([("vocab", vocab), ("edges", edges)])


@query("json_rows", "SELECT CAST(to_json({'id': p_partkey, 'name': p_name, 'size': CASE WHEN p_size > 25 THEN p_size END}) AS VARCHAR) AS value FROM part")
def _(t):
    return as_json(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size")))


@query("primary_files", """
SELECT l_partkey, l_orderkey || '/' || l_linenumber AS path FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'N' DESC, CASE WHEN l_linenumber > 1 THEN l_linenumber END DESC NULLS LAST, l_quantity DESC NULLS LAST, l_orderkey || '/' || l_linenumber) = 1""")
def _(t):
    n = F.col("l_linenumber")
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), n.cast("string"))
    files = t("lineitem").select("l_partkey", path.alias("path"), (F.col("l_returnflag") == "N").alias("present"), F.when(n > 1, n).alias("height"), F.col("l_quantity").alias("size"))
    return ranking.primary_file(files, ["l_partkey"]).select("l_partkey", "path")


@query("library_paths", "SELECT p_partkey, p_brand || '/' || p_name || ' x (' || (1950 + p_size) || ')/' || p_name || '.mkv' AS path FROM part")
def _(t):
    fields = {"library": F.col("p_brand"), "title": F.concat("p_name", F.lit(": x?")), "year": (F.col("p_size") + 1950).cast("string"), "name": F.concat(F.lit(" "), "p_name", F.lit(". "))}
    return t("part").select("p_partkey", T.rendered("{library}/{title} ({year})/{name}.mkv", fields).alias("path"))


@query("half_vectors", """
WITH v AS (SELECT vec_id, unnest(embedding) * 1e0 AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings)
SELECT vec_id, place, CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2e0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2e0, greatest(floor(log2(abs(x))), -14) - 10) END AS x FROM v""")
def _(t):
    each = t("embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return each.select("vec_id", F.col("place").cast("long"), vectors.half(F.col("x").cast("double")).alias("x"))


@query("language_facts", """
WITH i AS (SELECT p_partkey, CASE WHEN p_size < 40 THEN p_brand END AS of_show FROM part), k AS (SELECT p_brand AS owner, min(p_type) AS language FROM part WHERE p_size % 9 = 0 GROUP BY p_brand)
SELECT CAST(p_partkey AS VARCHAR) AS item_id, language FROM i JOIN k ON owner = coalesce(of_show, CAST(p_partkey AS VARCHAR))""")
def _(t):
    p = t("part")
    items = p.select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_size") < 40, F.col("p_brand")).alias("show_item_id"))
    return upkeep.language_facts(items, p.select(F.col("p_brand").alias("item_id"), F.when(F.col("p_size") % 9 == 0, F.col("p_type")).alias("language")))


@query("harvested_frames", """
WITH ok AS (SELECT p_partkey FROM part WHERE p_size % 3 = 0)
SELECT l_partkey AS item, l_orderkey AS frame FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (FROM ok) UNION ALL SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (FROM ok)""")
def _(t):
    frames = t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("frame"), "l_returnflag")
    outcomes = t("part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 3 == 0).alias("ok"))
    return upkeep.harvested(frames.where("l_returnflag = 'N'").drop("l_returnflag"), frames.where("l_returnflag = 'R'").drop("l_returnflag"), outcomes, "item")


@query("anime_answers", """
WITH e AS (SELECT l_orderkey AS entry, l_returnflag AS tag, l_linenumber AS rank, l_tax > 0.07 AS spoiler FROM lineitem), m AS (SELECT o_orderkey AS entry, o_custkey AS title FROM orders WHERE o_orderkey % 3 > 0)
SELECT title, tag, CAST(max(rank) AS BIGINT) AS rank, bool_or(spoiler) AS spoiler FROM e JOIN m USING (entry) GROUP BY ALL""")
def _(t):
    tag = F.struct(F.col("l_returnflag").alias("name"), F.lit("Theme").alias("category"), F.col("l_linenumber").alias("rank"), F.lit(None).cast("boolean").alias("isGeneralSpoiler"), (F.col("l_tax") > 0.07).alias("isMediaSpoiler"))
    media = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(tag).alias("tags"))
    body = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct("id", "tags")).alias("media")).alias("Page")).alias("data")))
    mapping = t("orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("title"))
    found = answers.anime_tags(media.select(body.alias("body")))
    return upkeep.merged_tags(found.join(mapping, "entry").select("title", "tag", "rank", "spoiler"))


@query("rating_answers", """
SELECT p_partkey, 'imdb' AS site, CASE WHEN p_size > 10 THEN p_retailprice * 1e0 END AS score, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS votes FROM part WHERE p_size > 10 OR p_size % 3 = 0 UNION ALL SELECT p_partkey, 'tmdb', 7.5, NULL FROM part""")
def _(t):
    n = F.col("p_size")
    rating = lambda site, score, votes: F.struct(F.lit(site).alias("source"), score.alias("score"), votes.cast("long").alias("votes"))
    both = F.array(rating("imdb", F.when(n > 10, F.col("p_retailprice").cast("double")), F.when(n % 3 == 0, n)), rating("tmdb", F.lit(7.5), F.lit(None)))
    return answers.site_ratings(t("part").select("p_partkey", F.to_json(F.struct(both.alias("ratings"))).alias("body")), "p_partkey")


@query("detail_answers", """
SELECT p_partkey AS id, p_type AS language, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(1950 + p_size AS INTEGER) END AS year FROM part""")
def _(t):
    n = F.col("p_size")
    date = F.concat((n + 1950).cast("string"), F.lit("-02-03"))
    fields = F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("original_language"), F.when(n % 3 == 1, date).otherwise("").alias("release_date"), F.when(n % 3 == 2, date).alias("first_air_date"))
    return answers.details(t("part").select(F.to_json(fields).alias("body")))
