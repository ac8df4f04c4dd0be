"""Queries of page, answer and stream sources: their inputs are written out of the tables, then read back through the source.

A brand is a list and its parts are the films on it, 50 a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinia.operators.shared import shared_path, stored
from affinia.plans.catalogue import ORACLES, QUERIES, query
from affinia.sources import answers, pages
from affinia.streaming import resolved as streams

PER_PAGE = 50


# --- pages -------------------------------------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _films(t) -> DataFrame:
    """brand, page, slug, label of each part, in order of its number."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    year = (F.col("p_size") + 1950).cast("string")
    label = F.when(F.col("p_size") % 2 == 0, _text(F.col("p_name"), " (", year, ")")).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", "p_size", F.col("p_brand").alias("brand"), _text("p", F.col("p_partkey").cast("string")).alias("slug"), label.alias("label"), F.floor(at / PER_PAGE).alias("page"), F.count(F.lit(1)).over(Window.partitionBy("p_brand")).alias("n"))


def _list_pages(t) -> DataFrame:
    """path, html. The list of Brand#3 lacks the markers on its pages, that of Brand#4 states too many films, that of Brand#5 leads nowhere."""
    item = _text('<li data-item-slug="', F.col("slug"), '" data-item-name="', F.col("label"), '"><a href="/film/', F.col("slug"), '/">x</a>')
    grouped = _films(t).groupBy("brand", "page", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), "\n").alias("items"))
    more = F.col("page") < F.floor((F.col("n") - 1) / PER_PAGE)
    path = _text("/", F.col("brand"), "/list/")
    after = F.when(more, _text('<a class="next" href="', path, (F.col("page") + 1).cast("string"), '">next</a>')).when(F.col("brand") == "Brand#5", F.lit('<a class="next" href="/gone/">next</a>')).otherwise("")
    size = F.col("n") + F.when(F.col("brand") == "Brand#4", 7).otherwise(0)
    body = F.when(F.col("brand") == "Brand#3", F.lit("<body>")).otherwise('<body class="films list-page">')
    html = _text('<html><head><meta name="description" content="A list of ', F.format_number(size, 0), ' films by x"></head>', body, '<h1 class="title-1">\n The  best of <b>', F.col("brand"), "</b> &amp; co</h1><ul>", F.col("items"), "</ul>", after, "</body>")
    return grouped.select(_text(path, F.col("page").cast("string")).alias("path"), "brand", "page", html.alias("html"))


def _lists(t) -> DataFrame:
    """list, path of each brand, and of one that has no page."""
    named = t("part").select(F.col("p_brand").alias("list")).distinct().select("list", _text("/", F.col("list"), "/list/0").alias("path"))
    return named.unionByName(named.limit(1).select(F.lit("nowhere").alias("list"), F.lit("/nowhere/").alias("path")))


def _film_pages(t) -> DataFrame:
    """slug, html: an even size is a film with an id, one of a series if it is a multiple of 4; a multiple of 9 isn't a film's page."""
    n = F.col("p_size")
    number = F.when(n % 2 == 0, _text(' data-tmdb-id="', F.col("p_partkey").cast("string"), '"')).otherwise("")
    kind = F.when(n % 4 == 0, F.lit("tv")).otherwise("movie")
    html = F.when(n % 9 == 0, F.lit("<body><h1>Just a moment</h1></body>")).otherwise(_text('<body class=film DATA-TYPE="film" data-tmdb-type="', kind, '"', number, ">x</body>"))
    return _films(t).select("slug", html.alias("html"))


def _known(t) -> DataFrame:
    """kind, tmdb_id, item_id of the titles that are held."""
    n = F.col("p_size")
    return t("part").where("p_size % 2 = 0 AND p_size % 3 = 0").select(F.when(n % 4 == 0, "show").otherwise("movie").alias("kind"), F.col("p_partkey").cast("string").alias("tmdb_id"), _text("i", F.col("p_partkey").cast("string")).alias("item_id"))


_YEAR = "CASE WHEN p_size % 2 = 0 THEN p_size + 1950 END"
_PLACE = "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1"


@query("list_page_entries", f"""
WITH f AS (SELECT *, {_PLACE} AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT '/' || p_brand || '/list/' || (pos // {PER_PAGE}) AS path, 'The best of ' || p_brand || ' & co' AS name, n + CASE WHEN p_brand = 'Brand#4' THEN 7 ELSE 0 END AS size,
       'p' || p_partkey AS slug, p_name AS title, CAST({_YEAR} AS INTEGER) AS year FROM f WHERE p_brand <> 'Brand#3'""")
def _(t):
    read = pages.read_lists(_list_pages(t), "path")
    return read.select("path", "name", "size", F.explode("entries").alias("e")).select("path", "name", "size", "e.slug", "e.title", "e.year")


@query("film_page_ids", """
SELECT 'p' || p_partkey AS slug, CASE WHEN p_size % 9 <> 0 THEN CASE WHEN p_size % 4 = 0 THEN 'show' ELSE 'movie' END END AS kind,
       CASE WHEN p_size % 9 <> 0 AND p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS tmdb_id FROM part""")
def _(t):
    return pages.read_films(_film_pages(t), "slug")


_OUTCOME = """CASE WHEN list = 'nowhere' THEN 'missing' WHEN list = 'Brand#3' THEN 'not_a_list' WHEN list = 'Brand#5' THEN 'broken' WHEN n > 2000 THEN 'too_long' WHEN list = 'Brand#4' THEN 'short' ELSE 'harvested' END"""


@query("list_harvest", f"""
WITH l AS (SELECT p_brand AS list, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'nowhere', 0)
SELECT list, CASE WHEN list NOT IN ('nowhere', 'Brand#3') THEN 'The best of ' || list || ' & co' END AS name, CASE WHEN list = 'Brand#3' THEN 0 ELSE n END AS entries, {_OUTCOME} AS outcome FROM l""")
def _(t):
    return pages.harvested(_lists(t), _list_pages(t), _film_pages(t), _known(t))[1]


@query("list_harvest_entries", f"""
WITH f AS (SELECT p_brand AS list, p_partkey, p_size, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, p_size % 9 <> 0 AND p_size % 2 = 0 AS has FROM part)
SELECT list, CAST(rank AS INTEGER) AS rank, CASE WHEN has THEN 'tmdb' ELSE 'page' END AS namespace, CASE WHEN has THEN CAST(p_partkey AS VARCHAR) ELSE 'p' || p_partkey END AS value,
       CASE WHEN has AND p_size % 3 = 0 THEN 'i' || p_partkey END AS item_id FROM f WHERE {_OUTCOME} = 'harvested'""")
def _(t):
    return pages.harvested(_lists(t), _list_pages(t), _film_pages(t), _known(t))[0]


def _theme_pages(t) -> DataFrame:
    """item_id, tmdb_id, html: a multiple of 11 isn't listed, one of 13 names another id, one of 7 has its themes under another heading, one of 5 has none."""
    n, number = F.col("p_size"), F.col("p_partkey").cast("string")
    link = lambda where, *label: _text(f'<a href="/films/{where}/x/">', *label, "</a>")
    links = _text('<div class="text-sluglist capitalize"><div>', link("theme", F.col("p_name")), link("mini-theme", "A  &lt;b&gt; ", F.col("p_type")), link("theme", F.col("p_name")), link("genre", "no"), "</div></div>", '<a href="/films/theme/late/">late</a>')
    heading = F.when(n % 7 == 0, F.lit("<h3>Genres</h3>")).otherwise("<h3> Themes </h3>")
    marker = F.when(n % 13 == 0, F.lit("0x")).otherwise(number)
    html = _text('<body data-tmdb-id="', marker, '">', heading, F.when(n % 5 == 0, F.lit("<p>none</p>")).otherwise(links), "</body>")
    return t("part").select(_text("i", number).alias("item_id"), number.alias("tmdb_id"), F.when(n % 11 != 0, html).alias("html"))


_PARSED = "p_size % 11 <> 0 AND p_size % 13 <> 0 AND (p_size % 7 <> 0 OR p_size % 5 = 0)"


@query("theme_facts", f"""
SELECT 'i' || p_partkey AS item_id, unnest([p_name, 'A <b> ' || p_type]) AS value, unnest([1, 2]) AS rank FROM part WHERE {_PARSED} AND p_size % 5 <> 0""")
def _(t):
    return pages.theme_facts(_theme_pages(t))[0]


@query("theme_run", f"""
SELECT count(*) FILTER ({_PARSED} OR p_size % 11 = 0) AS fetched, count(*) FILTER (p_size % 11 = 0) AS not_listed, count(*) FILTER ({_PARSED} AND p_size % 5 <> 0) AS matched,
       count(*) FILTER (p_size % 11 <> 0 AND NOT ({_PARSED})) AS unparsed, count(*) FILTER (p_size % 11 <> 0 AND NOT ({_PARSED})) > 1e-1 * count(*) FILTER (p_size % 11 <> 0) AS failed FROM part""")
def _(t):
    return pages.theme_facts(_theme_pages(t))[2]


@query("page_token_counts")
def _(t):
    found = pages.page_tokens(t("pages").select("page_id", "html"), "page_id")
    return found.groupBy("page_id", "kind", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("attrs")).alias("attrs"), F.sum(F.char_length("text")).alias("chars"))


# --- answers -----------------------------------------------------------------------------------------


def _json(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, body: the column answer as JSON text."""
    return rows.select(*keep, F.to_json("answer").alias("body"))


@query("answered_history", "SELECT 'h' || event_id AS history_key, 'r' || (event_id % 97) AS rating_key, user_id AS account_id, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id % 5 AS VARCHAR) END AS device_id, CAST(floor(epoch(ts)) AS BIGINT) AS viewed_at, event_type AS type FROM events")
def _(t):
    event = F.struct(
        _text("h", F.col("event_id").cast("string")).alias("historyKey"),
        _text("r", (F.col("event_id") % 97).cast("string")).alias("ratingKey"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("viewedAt"),
        F.col("user_id").alias("accountID"),
        F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 5).alias("deviceID"),
        F.col("event_type").alias("type"),
    )
    # Pages of a hundred events, as the server sends them.
    page = t("events").groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.struct(F.struct(F.collect_list(event).alias("Metadata")).alias("MediaContainer")).alias("answer"))
    return answers.history(_json(page))


@query("answered_listing", "SELECT 'r' || p_partkey AS rating_key, CASE WHEN p_size % 2 = 0 THEN 'movie' ELSE 'episode' END AS type, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 1950 + p_size END AS year, CASE WHEN p_size % 2 = 1 THEN p_brand END AS show, CASE WHEN p_size % 2 = 1 THEN p_size END AS season, 'imdb' AS namespace, 'tt' || p_partkey AS value, '/m/' || p_partkey || '.mkv' AS file FROM part")
def _(t):
    number, movie = F.col("p_partkey").cast("string"), F.col("p_size") % 2 == 0
    part = F.struct(F.array(F.struct(_text("/m/", number, ".mkv").alias("file"))).alias("Part"))
    row = F.struct(
        _text("r", number).alias("ratingKey"),
        F.when(movie, "movie").otherwise("episode").alias("type"),
        F.col("p_name").alias("title"),
        F.when(movie, F.col("p_size") + 1950).alias("year"),
        F.when(~movie, F.col("p_brand")).alias("grandparentTitle"),
        F.when(~movie, F.col("p_size")).alias("parentIndex"),
        F.array(F.struct(_text("imdb://tt", number).alias("id"))).alias("Guid"),
        F.array(part).alias("Media"),
    )
    page = t("part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.struct(F.struct(F.collect_list(row).alias("Metadata")).alias("MediaContainer")).alias("answer"))
    return answers.listing(_json(page))


@query("answered_related", "SELECT l_orderkey AS from_id, l_partkey AS to_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank, 'movie' AS kind FROM lineitem")
def _(t):
    result = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(x["l_partkey"].alias("id"), F.lit("movie").alias("media_type")))
    return answers.related(_json(t("lineitem").groupBy(F.col("l_orderkey").alias("from_id")).agg(F.struct(result.alias("results")).alias("answer")), "from_id"))


@query("answered_list_entries", f"""
SELECT p_brand AS list, CASE WHEN p_size % 2 = 0 THEN 'movie' ELSE 'show' END AS kind, 'tt' || p_partkey AS imdb_id, p_name AS title, {_PLACE} + 1 AS rank FROM part""")
def _(t):
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = t("part").select(F.col("p_brand").alias("list"), "p_size", F.struct(_text("tt", F.col("p_partkey").cast("string")).alias("imdb_id"), F.col("p_name").alias("title"), at.alias("rank")).alias("e"))
    of = lambda odd: F.collect_list(F.when(F.col("p_size") % 2 == odd, F.col("e")))
    return answers.list_entries(_json(rows.groupBy("list").agg(F.struct(of(0).alias("movies"), of(1).alias("shows")).alias("answer")), "list"))


@query("answered_statements", "SELECT 'tt' || p_partkey AS imdb, property, CASE WHEN property = 'type' THEN p_type ELSE p_brand END AS label FROM part, (VALUES ('type'), ('brand')) v(property)")
def _(t):
    value = lambda c: F.struct(c.alias("value"))
    imdb = _text("tt", F.col("p_partkey").cast("string"))
    both = F.array(*[F.struct(value(imdb).alias("imdb"), value(F.lit(p)).alias("prop"), value(F.col(c)).alias("label")) for p, c in (("type", "p_type"), ("brand", "p_brand"))])
    batch = t("part").groupBy(F.floor(F.col("p_partkey") / 200).alias("batch")).agg(F.struct(F.struct(F.flatten(F.collect_list(both)).alias("bindings")).alias("results")).alias("answer"))
    return answers.statements(_json(batch))


# --- streams -----------------------------------------------------------------------------------------


def streamed(name: str, sql: str | None = None):
    """A query that gets the session and a reader of tables, as it runs streams of its own."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _log(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """rows as a stream of files in the shared folder."""
    path = shared_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(path)


def _events(t) -> DataFrame:
    """Every eighth event comes twice."""
    rows = t("events").select(_text("h", F.col("event_id").cast("string")).alias("history_key"), _text("r", (F.col("event_id") % 97).cast("string")).alias("rating_key"), F.col("user_id").alias("account_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("viewed_at"), "event_id")
    return rows.unionByName(rows.where("event_id % 8 = 0")).drop("event_id")


def _identities(t) -> DataFrame:
    """Rating keys but those of multiples of 5."""
    return t("events").select((F.col("event_id") % 97).alias("k")).distinct().where("k % 5 <> 0").select(_text("r", F.col("k").cast("string")).alias("rating_key"), _text("i", F.col("k").cast("string")).alias("item_id"))


_PLAYED = "SELECT 'h' || event_id AS history_key, 'r' || (event_id % 97) AS rating_key, user_id AS account_id, CAST(floor(epoch(ts)) AS BIGINT) AS viewed_at, 'i' || (event_id % 97) AS item_id FROM events WHERE event_id % 97 % 5 <> 0"


def _plays(spark: SparkSession, t) -> DataFrame:
    to, at = shared_path(spark, "plays"), shared_path(spark, "plays-at")
    stream = streams.resolved(_log(spark, _events(t), "events"), _log(spark, _identities(t), "identities"))
    streams.written(stream, to, at).awaitTermination()
    return spark.read.schema(stream.schema).parquet(to)


@streamed("stream_plays", _PLAYED)
def stream_plays(spark, t):
    return _plays(spark, t)


@streamed("stream_cursor", "SELECT CAST(floor(epoch(coalesce(min(ts) FILTER (event_id % 97 % 5 = 0), max(ts)))) AS BIGINT) AS since, count(*) FILTER (event_id % 97 % 5 = 0) AS waiting FROM events")
def _(spark, t):
    return streams.cursor(_events(t), _plays(spark, t))


@streamed("stream_outcomes")
def stream_outcomes(spark, t):
    """A customer's file is tried at each event of theirs: its size changes with the day, the event says how it went."""
    result = F.when(F.col("event_type") == "error", streams.UNREACHABLE).when(F.col("event_type") == "purchase", streams.DONE).when(F.col("value") > 50, streams.FAILED).otherwise(streams.UNREACHABLE)
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    rows = t("events").select(_text("f", F.col("user_id").cast("string")).alias("file"), F.floor(at / 86400).alias("size"), at.alias("at"), result.alias("result"))
    to, place = shared_path(spark, "outcomes"), shared_path(spark, "outcomes-at")
    stream = streams.outcomes(_log(spark, rows, "attempts"))
    streams.written(stream, to, place).awaitTermination()
    return spark.read.schema(stream.schema).parquet(to)


# --- recursion ---------------------------------------------------------------------------------------

_UP = """
WITH RECURSIVE up(part, node, steps) {most} AS (
    SELECT p_partkey, p_partkey, 0 FROM {part} UNION ALL SELECT up.part, CAST(floor(up.node / 2) AS BIGINT), up.steps + 1 FROM up WHERE up.node > 0)
SELECT part, max(steps) AS steps, sum(node) AS total FROM up GROUP BY part"""


@query("recursive_reach", _UP.format(most="", part="part").replace("floor(up.node / 2)", "up.node // 2").replace("sum(node)", "CAST(sum(node) AS BIGINT)"))
def _(t):
    """Each part's way up a binary tree, by a recursive query."""
    part = stored(t("part").select("p_partkey"), "parts")
    # LIMIT ALL lifts the million rows at which a recursion would stop.
    up = _UP.format(most="MAX RECURSION LEVEL 70", part="{part}").replace("FROM up GROUP", "FROM (SELECT * FROM up LIMIT ALL) GROUP")
    return part.sparkSession.sql(up, part=part)
