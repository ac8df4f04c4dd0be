"""More registered queries: recipes, upkeep of the store, and text functions, each with its SQL.

Stand-ins for a store: a part is a movie if it is large, else an episode of its brand's show; an order's line is
a play; a line's supplier number is the item that an edge goes to; sizes are collections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.functions import text as T
from affinia.operators import changes, clusters, ranking, timeline, upkeep, vectors
from affinia.plans import sqlbox
from affinia.plans.catalogue import ORACLES, QUERIES, query
from affinia.plans.recipes import RECIPES

__all__ = ["ORACLES", "QUERIES"]


def _id(size: str = "p_size", key: str = "p_partkey"):
    return F.when(F.col(size) >= 40, F.concat(F.lit("m:"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("e:"), F.col(key).cast("string")))


def _store(t):
    """The tables of a store, from the driver's."""
    part = t("part")
    ids = part.select("p_partkey", _id().alias("item_id"))
    null = lambda kind: F.lit(None).cast(kind)

    def items() -> DataFrame:
        movie = F.col("p_size") >= 40
        own = part.select(_id().alias("item_id"), F.when(movie, "movie").otherwise("episode").alias("type"), F.col("p_name").alias("title"), F.when(movie, F.col("p_size") + 1950).cast("long").alias("year"), F.when(~movie, F.concat(F.lit("s:"), "p_brand")).alias("show_item_id"), F.when(~movie, F.col("p_size") % 5).cast("long").alias("season"))
        shows = part.select(F.concat(F.lit("s:"), "p_brand").alias("item_id"), F.lit("show").alias("type"), F.col("p_brand").alias("title"), null("long").alias("year"), null("string").alias("show_item_id"), null("long").alias("season")).distinct()
        return own.unionByName(shows)

    def plays() -> DataFrame:
        lines = t("lineitem").select("l_orderkey", "l_partkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("viewed_at"))
        orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("account_id"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(ids, F.col("l_partkey") == F.col("p_partkey")).select("account_id", "item_id", "viewed_at")

    def enrichment() -> DataFrame:
        fact = lambda ns, key, v: part.select(_id().alias("item_id"), F.lit(ns).alias("namespace"), F.lit(key).alias("key"), F.col(v).alias("value"))
        return fact("keywords", "keyword", "p_name").unionByName(fact("keywords", "maker", "p_brand")).unionByName(fact("facts", "type", "p_type"))

    def edges() -> DataFrame:
        to = ids.select(F.col("p_partkey").alias("to_key"), F.col("item_id").alias("to_id"))
        lines = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").cast("long").alias("rank"))
        return lines.join(ids, F.col("l_partkey") == F.col("p_partkey")).join(to, F.col("l_suppkey") == F.col("to_key")).select(F.col("item_id").alias("from_id"), "to_id", F.lit("similar").alias("edge_type"), "rank")

    def collection() -> DataFrame:
        return part.groupBy(F.col("p_size").cast("long").alias("collection_id")).agg(F.max(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("name"), F.count(F.lit(1)).alias("likes"))

    def collection_membership() -> DataFrame:
        return part.select(_id().alias("item_id"), F.col("p_size").cast("long").alias("collection_id"), F.col("p_partkey").alias("rank"))

    tables = {f.__name__: f for f in (items, plays, enrichment, edges, collection, collection_membership)}
    return lambda name: tables[name]()


_ID = "CASE WHEN p_size >= 40 THEN 'm:' || p_partkey ELSE 'e:' || p_partkey END"
_ITEMS = f"""items AS (SELECT {_ID} AS item_id, CASE WHEN p_size >= 40 THEN 'movie' ELSE 'episode' END AS type, p_name AS title, CASE WHEN p_size >= 40 THEN CAST(p_size + 1950 AS BIGINT) END AS year,
    CASE WHEN p_size < 40 THEN 's:' || p_brand END AS show_item_id, CASE WHEN p_size < 40 THEN CAST(p_size % 5 AS BIGINT) END AS season FROM part
  UNION ALL SELECT DISTINCT 's:' || p_brand, 'show', p_brand, NULL::BIGINT, NULL, NULL::BIGINT FROM part)"""
_PLAYS = f"plays AS (SELECT o_custkey AS account_id, {_ID} AS item_id, CAST(epoch(l_shipdate) AS BIGINT) AS viewed_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"
_FACTS = f"enrichment AS (SELECT {_ID} AS item_id, 'keywords' AS namespace, 'keyword' AS key, p_name AS value FROM part UNION ALL SELECT {_ID}, 'keywords', 'maker', p_brand FROM part UNION ALL SELECT {_ID}, 'facts', 'type', p_type FROM part)"
_EDGES = f"""ids AS (SELECT p_partkey, {_ID} AS id FROM part), edges AS (SELECT a.id AS from_id, b.id AS to_id, CAST(min(l_linenumber) AS BIGINT) AS rank FROM lineitem JOIN ids a ON a.p_partkey = l_partkey JOIN ids b ON b.p_partkey = l_suppkey GROUP BY ALL)"""
_UNITS = "units AS (SELECT account_id, coalesce(show_item_id, item_id) AS unit FROM plays JOIN items USING (item_id))"


def _recipe(name: str, sql: str, as_: str | None = None, **args):
    query(f"recipe_{as_ or name}", sql)(lambda t: RECIPES[name][1](_store(t), **args))


_recipe("rows_per_table", f"WITH {_ITEMS}, {_PLAYS}, {_FACTS}, {_EDGES} SELECT 'items' AS name, count(*) AS n FROM items UNION ALL SELECT 'plays', count(*) FROM plays UNION ALL SELECT 'enrichment', count(*) FROM enrichment UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'collection', count(DISTINCT p_size) FROM part UNION ALL SELECT 'collection_membership', count(*) FROM part")
_recipe("titles_per_type", f"WITH {_ITEMS} SELECT type, count(*) AS titles FROM items GROUP BY type")
_recipe("keys_per_namespace", f"WITH {_FACTS} SELECT namespace, key, count(*) AS n, count(DISTINCT item_id) AS titles, count(DISTINCT value) AS values FROM enrichment GROUP BY ALL ORDER BY n DESC, namespace, key LIMIT 50")
_recipe("plays_per_account", f"WITH {_PLAYS} SELECT account_id, count(*) AS plays, min(viewed_at) AS first, max(viewed_at) AS last FROM plays GROUP BY account_id")
_recipe("facts_of", f"WITH {_ITEMS}, {_FACTS} SELECT item_id, namespace, key, value, title, year FROM enrichment LEFT JOIN items USING (item_id) WHERE item_id IN ('e:0', 'e:1', 'm:3', 'e:5', 'm:7', 'gone') AND namespace = 'keywords'", ids=["e:0", "e:1", "m:3", "e:5", "m:7", "gone"], namespace="keywords")
_recipe("attributes_of", f"WITH {_ITEMS}, {_FACTS} SELECT DISTINCT item_id, namespace, key, value, title, year FROM enrichment LEFT JOIN items USING (item_id) WHERE item_id = 'e:0'", item_id="e:0")
for _name, _end in (("edges_from", "from_id"), ("edges_to", "to_id")):
    _recipe("edges_of", f"WITH {_ITEMS}, {_EDGES} SELECT from_id, to_id, rank, f.title AS from_title, f.year AS from_year, o.title AS to_title, o.year AS to_year FROM edges LEFT JOIN items f ON f.item_id = from_id LEFT JOIN items o ON o.item_id = to_id WHERE {_end} = 'e:0'", _name, item_id="e:0", edge_type="similar", inward=_end == "to_id")
_recipe("collections_of", f"SELECT CAST(p.p_size AS BIGINT) AS collection_id, 'size ' || p.p_size AS name, (SELECT count(*) FROM part x WHERE x.p_size = p.p_size) AS likes, p_partkey AS rank FROM part p WHERE {_ID} = 'e:0'", item_id="e:0")
_recipe("units_of", f"WITH {_ITEMS}, {_PLAYS}, {_UNITS} SELECT unit, count(*) AS plays, any_value(title) AS title, any_value(year) AS year FROM units LEFT JOIN items ON item_id = unit WHERE account_id = 1 GROUP BY unit", account=1)
_recipe("watched_by", f"WITH {_ITEMS}, {_PLAYS}, {_UNITS} SELECT DISTINCT unit, title, year FROM units LEFT JOIN items ON item_id = unit WHERE account_id = 1", "watched_by_one", account=1)
_recipe("watched_by", f"WITH {_ITEMS}, {_PLAYS}, {_UNITS} SELECT DISTINCT unit, title, year FROM units LEFT JOIN items ON item_id = unit", "watched_by_any")
_recipe("pooled_units", f"WITH {_ITEMS}, {_PLAYS}, {_UNITS} SELECT unit, count(*) AS plays, any_value(title) AS title, any_value(year) AS year FROM units LEFT JOIN items ON item_id = unit GROUP BY unit")
_recipe("season_sizes", f"WITH {_ITEMS} SELECT e.show_item_id, e.season, count(*) AS episodes, any_value(s.title) AS title FROM items e LEFT JOIN items s ON s.item_id = e.show_item_id WHERE e.type = 'episode' AND e.season IS NOT NULL GROUP BY e.show_item_id, e.season")

# --- what is kept, due and changed ---------------------------------------------------------------------


@query("walk_claims", """
WITH l AS (SELECT p_partkey AS rating_key, CASE WHEN p_size > 5 THEN p_name || '/' || p_type || '/' || p_size END AS item_id FROM part), f AS (SELECT *, min(rating_key) OVER (PARTITION BY item_id) AS first FROM l)
SELECT rating_key, CASE WHEN item_id IS NOT NULL AND rating_key = first THEN item_id ELSE 'plex:' || rating_key END AS item_id, CASE WHEN item_id IS NULL THEN 'new' WHEN rating_key = first THEN 'kept' ELSE 'forked' END AS state FROM f""")
def _(t):
    item = F.when(F.col("p_size") > 5, F.concat_ws("/", "p_name", "p_type", F.col("p_size").cast("string")))
    return upkeep.claimed(t("part").select(F.col("p_partkey").alias("rating_key"), item.alias("item_id")))


@query("edge_refresh", """
WITH o AS (SELECT DISTINCT l_partkey AS from_id, l_suppkey AS to_id, 0 AS rank FROM lineitem WHERE l_returnflag = 'N'), n AS (SELECT l_partkey AS from_id, l_suppkey * 11 AS to_id, min(l_linenumber) AS rank FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT * FROM o WHERE from_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) UNION ALL SELECT * FROM n WHERE from_id <> to_id AND to_id IN (SELECT p_partkey FROM part)""")
def _(t):
    lines = t("lineitem")
    old = lines.where("l_returnflag = 'N'").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.lit(0).alias("rank")).distinct()
    new = lines.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("from_id"), (F.col("l_suppkey") * 11).alias("to_id")).agg(F.min("l_linenumber").alias("rank"))
    part = t("part")
    return upkeep.refreshed_edges(old, new, part.select(F.col("p_partkey").alias("item_id")), part.where("p_size < 25").select(F.col("p_partkey").alias("from_id")))


@query("anime_tags", "SELECT l_suppkey AS title, l_returnflag AS tag, max(CASE WHEN l_linenumber > 2 THEN l_linenumber END) AS rank, bool_or(l_tax > 0.07) AS spoiler FROM lineitem GROUP BY ALL")
def _(t):
    entries = t("lineitem").select(F.col("l_suppkey").alias("title"), F.col("l_returnflag").alias("tag"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("rank"), (F.col("l_tax") > 0.07).alias("spoiler"))
    return upkeep.merged_tags(entries)


@query("rating_facts", """
WITH r AS (SELECT p_partkey AS item, p_brand AS site, CASE WHEN p_size > 10 THEN p_retailprice END AS score, CASE WHEN p_size % 3 = 0 THEN p_size * 1e0 END AS votes FROM part)
SELECT item, site AS key, score AS value FROM r WHERE score IS NOT NULL UNION ALL SELECT item, site || '_votes', votes FROM r WHERE votes IS NOT NULL""")
def _(t):
    return upkeep.rating_facts(t("part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("site"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("score"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("votes")))


@query("list_search", """
WITH f AS (SELECT o_custkey AS seed, l_partkey % 97 AS url FROM orders JOIN lineitem ON l_orderkey = o_orderkey), e AS (SELECT p_partkey % 97 AS url, p_partkey AS item FROM part), b AS (SELECT p_partkey AS item FROM part WHERE p_size > 20), r AS (SELECT p_partkey AS url FROM part WHERE p_partkey % 10 = 0),
     s AS (SELECT url, count(DISTINCT seed) AS seeds FROM f WHERE url NOT IN (FROM r) GROUP BY url), k AS (SELECT url, count(DISTINCT item) AS titles FROM e WHERE item IN (FROM b) GROUP BY url HAVING count(DISTINCT item) >= 5)
SELECT url, seeds, titles FROM s JOIN k USING (url)""")
def _(t):
    found = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("seed"), (F.col("l_partkey") % 97).alias("url"))
    part = t("part")
    entries = part.select((F.col("p_partkey") % 97).alias("url"), F.col("p_partkey").alias("item"))
    return upkeep.list_candidates(found, entries, part.where("p_size > 20").select(F.col("p_partkey").alias("item")), part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("url")))


@query("pruned_frames", "SELECT vec_id, label FROM embeddings WHERE label IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def _(t):
    live = t("supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("label"))
    return upkeep.kept_with(t("embeddings").select("vec_id", "label"), live, ["label"])


@query("frame_queue", "SELECT c_custkey AS item, c_nationkey * 1e0 AS asked FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 1000.0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def _(t):
    c = t("customer")
    queue = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("double").alias("asked"))
    return upkeep.queued(queue, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("item"), F.lit(1000.0).alias("asked")), "item")


@query("library_roles", """
WITH w AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT 'unknown'), s AS (SELECT p_type AS name, p_size AS place, p_partkey AS section FROM part)
SELECT w.name, (SELECT arg_min(section, (place, section)) FROM s WHERE s.name = w.name) AS section FROM w""")
def _(t):
    sections = t("part").select(F.col("p_type").alias("name"), F.lit("x").alias("kind"), F.col("p_size").alias("place"), F.col("p_partkey").alias("section"))
    wanted = sections.select("name").distinct().union(t("part").limit(1).select(F.lit("unknown")))
    return upkeep.library_roles(wanted, sections)


@query("display_labels", """
WITH f AS (SELECT DISTINCT p_partkey AS keyword, p_name AS readable FROM part), n AS (SELECT p_partkey AS keyword, upper(p_name) AS name, p_size AS decided_at FROM part WHERE p_partkey % 7 = 3), g AS (SELECT p_partkey AS keyword, p_partkey // 5 * 5 AS head FROM part),
     h AS (SELECT head, arg_max(name, (decided_at, keyword)) AS of_group FROM n JOIN g USING (keyword) GROUP BY head)
SELECT f.keyword, coalesce(n.name, CASE WHEN g.head = f.keyword THEN of_group END, readable) AS label FROM f JOIN g USING (keyword) LEFT JOIN n USING (keyword) LEFT JOIN h USING (head)""")
def _(t):
    p = t("part")
    k = F.col("p_partkey").alias("keyword")
    names = p.where("p_partkey % 7 = 3").select(k, F.upper("p_name").alias("name"), F.col("p_size").alias("decided_at"))
    return upkeep.display_labels(p.select(k, F.col("p_name").alias("readable")), names, p.select(k, (F.floor(F.col("p_partkey") / 5) * 5).alias("head")))


@query("not_judged", "SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = l_suppkey % 25)")
def _(t):
    pairs = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    judged = t("customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("r"))
    return upkeep.not_judged(pairs.withColumn("r", F.col("b") % 25), judged, ["a", "r"]).select("a", "b")


@query("changed_media", """
WITH l AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size > 5), o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_size < 45)
SELECT k, CASE WHEN l.k IS NULL THEN 'gone' WHEN o.k IS NULL THEN 'new' ELSE 'changed' END AS why FROM l FULL JOIN o USING (k) WHERE l.s IS DISTINCT FROM o.s""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    stored = p.where("s < 45").select("k", F.when(F.col("k") % 3 == 0, F.col("s") + 1).otherwise(F.col("s")).alias("s"))
    return upkeep.changed_since(p.where("s > 5"), stored, "k", "s")


@query("rekeyed_items", """
WITH m AS (SELECT p_partkey AS old, p_partkey // 4 * 4 AS new FROM part WHERE p_partkey % 4 <> 0 AND p_size > 10), r AS (SELECT coalesce(new, p_partkey) AS item, p_brand AS fact, p_size AS n, new IS NOT NULL AS moved, p_partkey AS was FROM part LEFT JOIN m ON old = p_partkey)
SELECT item, fact, n FROM r QUALIFY row_number() OVER (PARTITION BY item, fact ORDER BY moved, was) = 1""")
def _(t):
    p = t("part")
    mapping = p.where("p_partkey % 4 <> 0 AND p_size > 10").select(F.col("p_partkey").alias("old"), (F.floor(F.col("p_partkey") / 4) * 4).alias("new"))
    return upkeep.rekeyed(p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("fact"), F.col("p_size").alias("n")), mapping, "item", ["item", "fact"])


@query("harvest_outcomes", """
WITH f AS (SELECT p_partkey, [NULL, 'done', 'failed', 'excluded', 'unreachable'][1 + p_partkey % 5] AS state, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 7 END AS seen_size, p_size * 1e0 AS hours FROM part)
SELECT p_partkey, CASE WHEN state IS NULL THEN 'try' WHEN state IN ('done', 'failed', 'excluded') AND size IS NOT DISTINCT FROM seen_size THEN state WHEN state = 'unreachable' AND hours < 24 THEN 'wait' ELSE 'try' END AS outcome FROM f""")
def _(t):
    state = F.get(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in ("done", "failed", "excluded", "unreachable")]), (F.col("p_partkey") % 5).cast("int"))
    files = t("part").select("p_partkey", state.alias("state"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).otherwise(7).alias("seen_size"), F.col("p_size").cast("double").alias("hours"))
    return files.select("p_partkey", upkeep.outcome(F.lit(24.0)).alias("outcome"))


@query("audio_status", """
WITH f AS (SELECT p_brand AS library, [NULL, 'done', 'failed'][1 + p_partkey % 3] AS state FROM part) SELECT library, coalesce(state, 'queued') AS state, count(*) AS n FROM f GROUP BY ALL""")
def _(t):
    state = F.get(F.array(F.lit(None).cast("string"), F.lit("done"), F.lit("failed")), (F.col("p_partkey") % 3).cast("int"))
    return t("part").groupBy(F.col("p_brand").alias("library"), F.coalesce(state, F.lit("queued")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("work_phases", "SELECT k, min(phase) AS phase FROM (SELECT c_custkey AS k, 0 AS phase FROM customer WHERE c_acctbal < 0 UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY k")
def _(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return upkeep.first_phase([c.where("c_acctbal < 0"), t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), c], "k")


@query("labelled_cells", """
WITH c AS (SELECT unnest([CASE WHEN p_size % 3 = 0 THEN 'imdb:' || p_partkey END, p_name, 'tmdb:' || p_size]) AS cell FROM part), l AS (SELECT 'imdb:' || p_partkey AS id, p_name AS label FROM part WHERE p_partkey % 2 = 0)
SELECT DISTINCT cell, label FROM c LEFT JOIN l ON id = cell WHERE regexp_matches(cell, '^(imdb|tmdb|tvdb|plex|fs):')""")
def _(t):
    p = t("part")
    key = F.concat(F.lit("imdb:"), F.col("p_partkey").cast("string"))
    cells = p.select(F.explode(F.array(F.when(F.col("p_size") % 3 == 0, key), F.col("p_name"), F.concat(F.lit("tmdb:"), F.col("p_size").cast("string")))).alias("cell"))
    return upkeep.labelled_cells(cells, p.where("p_partkey % 2 = 0").select(key.alias("id"), F.col("p_name").alias("label")))


@query("file_reasons", """
WITH f AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path, l_linenumber % 4 AS video, l_linenumber % 3 AS audio, l_quantity AS duration, l_quantity * (1 + l_discount / 3) AS expected FROM lineitem),
     r AS (SELECT path, list_filter([CASE WHEN video = 0 THEN 'no video' END, CASE WHEN audio = 0 THEN 'no audio' END, CASE WHEN abs(duration - expected) > 0.02 * expected THEN 'duration' END], lambda x: x IS NOT NULL) AS reasons FROM f)
SELECT * FROM r WHERE len(reasons) > 0""")
def _(t):
    path = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    return upkeep.file_reasons(t("lineitem").select(path.alias("path"), (F.col("l_linenumber") % 4).alias("video"), (F.col("l_linenumber") % 3).alias("audio"), F.col("l_quantity").alias("duration"), (F.col("l_quantity") * (1 + F.col("l_discount") / 3)).alias("expected")))


@query("list_totals", """
WITH l AS (SELECT DISTINCT p_size AS list, p_size % 4 AS source, p_size % 7 AS failures FROM part), c AS (SELECT p_size AS list, count(*) AS n, count(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) THEN 1 END) AS own FROM part WHERE p_size > 3 GROUP BY p_size)
SELECT source, count(*) AS lists, CAST(coalesce(sum(n), 0) AS BIGINT) AS entries, CAST(coalesce(sum(own), 0) AS BIGINT) AS owned, count(*) FILTER (failures > 0) AS failures FROM l LEFT JOIN c USING (list) GROUP BY source""")
def _(t):
    p = t("part")
    lists = p.select(F.col("p_size").alias("list"), (F.col("p_size") % 4).alias("source"), (F.col("p_size") % 7).alias("failures")).distinct()
    owned = t("lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("item")).distinct()
    return upkeep.list_totals(lists, p.where("p_size > 3").select(F.col("p_size").alias("list"), F.col("p_partkey").alias("item")), owned)


@query("health", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'names twice', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) UNION ALL SELECT 'orders of nobody', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    twice = t("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    nobody = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return upkeep.health({"orders": t("orders"), "names twice": twice, "orders of nobody": nobody})


def _arrivals(t):
    e = t("events")
    known = e.where("event_id % 5 = 0").select(F.col("event_id").cast("string").alias("history_key"))
    new = e.select(F.col("event_id").cast("string").alias("history_key"), F.col("user_id").alias("rating_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("viewed_at"))
    ids = t("customer").where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("rating_key"), F.col("c_name").alias("item_id"))
    return upkeep.once_ingested(known, new.unionByName(new.where("rating_key % 2 = 0")), ids)


_FRESH = "f AS (SELECT DISTINCT CAST(event_id AS VARCHAR) AS history_key, user_id AS rating_key, CAST(floor(epoch(ts)) AS BIGINT) AS viewed_at, c_name AS item_id FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 1) ON c_custkey = user_id WHERE event_id % 5 <> 0)"


@query("event_ingest", f"WITH {_FRESH} SELECT history_key, rating_key, viewed_at, item_id FROM f WHERE item_id IS NOT NULL")
def _(t):
    return _arrivals(t)[0]


@query("event_cursor", f"WITH {_FRESH} SELECT coalesce(min(viewed_at) FILTER (item_id IS NULL), max(viewed_at)) AS since FROM f")
def _(t):
    return _arrivals(t)[2]


@query("synonym_pairs", """
WITH f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT x.id, y.id AS other, round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) AS c FROM f x JOIN f y ON x.id <> y.id),
     k AS (SELECT * FROM s WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, other) <= 10)
SELECT least(id, other) AS a, greatest(id, other) AS b, max(c) AS score FROM k WHERE c >= 0.35 AND least(id, other) % 9 <> 0 GROUP BY ALL""")
def _(t):
    e = t("embeddings")
    near = vectors.nearest_vectors(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, 0.3)
    judged = near.where(F.least("id", "other") % 9 == 0).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return upkeep.synonym_pairs(near, judged, 0.35)


@query("unit_square", "SELECT vec_id AS id, round((embedding[1] - min(embedding[1]) OVER ()) * 1e0 / greatest(max(embedding[1]) OVER () - min(embedding[1]) OVER (), max(embedding[2]) OVER () - min(embedding[2]) OVER ()), 4) AS x, round((embedding[2] - min(embedding[2]) OVER ()) * 1e0 / greatest(max(embedding[1]) OVER () - min(embedding[1]) OVER (), max(embedding[2]) OVER () - min(embedding[2]) OVER ()), 4) AS y FROM embeddings")
def _(t):
    points = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return upkeep.unit_square(points).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- aggregates, windows, pages -----------------------------------------------------------------------


@query("first_order", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first FROM customer")
def _(t):
    best = t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return t("customer").select("c_custkey").join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "first")


@query("queue_counts", "SELECT p_brand, count(*) FILTER (p_size > 40) AS failed, count(*) FILTER (p_size < 10) AS queued, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 40).alias("failed"), F.count_if(F.col("p_size") < 10).alias("queued"), F.count(F.lit(1)).alias("n"))


@query("longest_run", """
WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
     r AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, k)
SELECT user_id, first, last, n FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def _(t):
    return timeline.longest_run(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type"))


@query("landing_bar", """
WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bar, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 6) AS mean FROM events), p AS (SELECT *, max(mean) OVER (PARTITION BY user_id) AS peak FROM m)
SELECT user_id, min(bar) AS bar FROM p WHERE bar % 8 = 0 AND mean >= peak * 0.8 GROUP BY user_id""")
def _(t):
    return timeline.landing(t("events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("inside_hours", "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS night, hour(ts) >= 9 AND hour(ts) < 17 AS day FROM events")
def _(t):
    hour = F.hour("ts")
    return t("events").select("event_id", T.inside_hours(hour, 22, 6).alias("night"), T.inside_hours(hour, 9, 17).alias("day"))


@query("capped_rows", "SELECT p_partkey, true AS truncated FROM part ORDER BY p_partkey LIMIT 100")
def _(t):
    rows, more = ranking.capped(t("part").select("p_partkey"), [F.asc("p_partkey")], 100)
    return rows.crossJoin(F.broadcast(more))  # one row


@query("panel_history", """
WITH h AS (SELECT p_brand AS series, p_size AS day, max(p_retailprice) AS value FROM part WHERE p_size < 30 GROUP BY ALL), n AS (SELECT p_brand AS series, p_size AS day, CASE WHEN any_value(p_size) % 2 = 0 THEN min(p_retailprice) END AS value FROM part WHERE p_size >= 20 GROUP BY ALL)
SELECT series, day, coalesce(n.value, h.value) AS value FROM h FULL JOIN n USING (series, day)""")
def _(t):
    p = t("part").groupBy(F.col("p_brand").alias("series"), F.col("p_size").alias("day")).agg(F.max("p_retailprice").alias("high"), F.min("p_retailprice").alias("low"))
    history = p.where("day < 30").select("series", "day", F.col("high").alias("value"))
    return sqlbox.recorded(history, p.where("day >= 20").select("series", "day", F.when(F.col("day") % 2 == 0, F.col("low")).alias("value")))


@query("fetch_gate", """
SELECT p_partkey, CASE WHEN p_size % 4 <> 1 AND p_size % 5 >= 3 THEN 'stopped' WHEN p_size % 3 = 0 THEN 'fetch' WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 THEN 'cached' ELSE 'fetch' END AS gate FROM part""")
def _(t):
    n, k = F.col("p_size"), F.col("p_partkey")
    rows = t("part").select("p_partkey", (n % 4 == 1).alias("retry"), (n % 5).alias("failures"), (n % 2 == 0).alias("stocked"), (k % 2 == 1).alias("stale"), (n % 3 == 0).alias("refetch"))
    return rows.select("p_partkey", changes.fetch_gate().alias("gate"))


@query("folded_keywords", "SELECT DISTINCT l_suppkey AS item, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'Brand#1' ELSE p_brand END AS keyword FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t):
    values = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("item"), F.col("p_brand").alias("keyword"))
    merges = t("part").where("p_brand IN ('Brand#2', 'Brand#3')").select(F.col("p_brand").alias("member"), F.lit("Brand#1").alias("representative")).distinct()
    return clusters.folded(values, merges)


@query("near_duplicate_fold", """
WITH g AS (SELECT p_partkey AS item, p_partkey // 6 AS k, p_size > 45 AS organized, CASE WHEN p_size % 4 > 0 THEN p_size END AS since FROM part), h AS (SELECT k, first(item ORDER BY NOT organized, since IS NULL, since, item) AS kept FROM g GROUP BY k)
SELECT item, kept FROM g JOIN h USING (k) WHERE item <> kept""")
def _(t):
    k = F.col("p_partkey")
    top = t("part").agg(F.max("p_partkey").alias("top"))
    whole = t("part").crossJoin(F.broadcast(top)).where(k < F.col("top"))  # one row
    pairs = whole.where(k % 6 < 5).select(k.alias("a"), (k + 1).alias("b"), F.lit(0.98).alias("score"))
    apart = whole.where(k % 6 == 5).select(k.alias("a"), (k + 1).alias("b"), F.lit(0.96).alias("score"))
    items = t("part").select(k.alias("item"), (F.col("p_size") > 45).alias("organized"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("since"))
    return clusters.near_duplicate_fold(pairs.unionByName(apart), items)


# --- text ---------------------------------------------------------------------------------------------


@query("text_fields", """
WITH r AS (SELECT p_partkey, p_size, p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || (1950 + p_size) || ')' ELSE '' END AS named, CASE WHEN p_size % 3 = 0 THEN 'imdb://tt' || p_partkey ELSE p_name END AS guid FROM part)
SELECT p_partkey, regexp_replace(named, ' \\(\\d{4}\\)$', '') AS name, TRY_CAST(regexp_extract(named, ' \\((\\d{4})\\)$', 1) AS INTEGER) AS year, CASE WHEN p_size % 5 < 3 THEN p_partkey END AS size, CASE WHEN contains(guid, '://') THEN split_part(guid, '://', 1) END AS namespace, CASE WHEN contains(guid, '://') THEN split_part(guid, '://', 2) END AS value FROM r""")
def _(t):
    n, k = F.col("p_size"), F.col("p_partkey")
    named = F.concat("p_name", F.when(n % 2 == 0, F.concat(F.lit(" ("), (n + 1950).cast("string"), F.lit(")"))).otherwise(""))
    guid = F.when(n % 3 == 0, F.concat(F.lit("imdb://tt"), k.cast("string"))).otherwise(F.col("p_name"))
    # "Not A list" states a size, "xA list" and "filmsy" don't.
    before, after = (F.get(F.array(*[F.lit(x) for x in some]), n % 5) for some in (("", "Not ", "", "x", ""), (" films", " film by x", " films.", " films", " filmsy")))
    sized = F.concat(before, F.lit("A list of "), F.format_number(k, 0), after)
    rows = t("part").select("p_partkey", T.name_year(named).alias("n"), T.list_size(sized).alias("size"), T.guid(guid).alias("g"))
    return rows.select("p_partkey", "n.name", "n.year", "size", "g.namespace", "g.value")


@query("file_names", """
WITH f AS (SELECT p_partkey, replace(p_name, ' ', '.') || '.S' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'E01.' || CASE WHEN p_size % 2 = 0 THEN '1080p' ELSE 'uhd' END || ' : x?.mkv' AS f FROM part)
SELECT p_partkey, nullif(regexp_extract(f, 'S(\\d\\d)E\\d\\d', 1), '') AS season, coalesce(nullif(regexp_extract(f, '(\\d{3,4})p', 1), ''), nullif(regexp_extract(f, 'uhd', 0), '')) AS quality, regexp_replace(trim(regexp_replace(regexp_replace(f, '[<>:"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g')), '[. ]+$', '') AS segment FROM f""")
def _(t):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".S"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("E01."), F.when(F.col("p_size") % 2 == 0, "1080p").otherwise("uhd"), F.lit(" : x?.mkv"))
    fields = T.parsed(name, [("season", r"S(\d\d)E\d\d", 1), ("quality", r"(\d{3,4})p", 1), ("quality", "uhd", 0)])
    return t("part").select("p_partkey", *[c.alias(f) for f, c in fields.items()], T.path_segment(name).alias("segment"))


@query("canonical_paths", """
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '/media/tv/' || p_name WHEN 1 THEN '/media\\' || p_brand ELSE '/other/' || p_name END AS path FROM part), q AS (SELECT p_partkey, replace(path, '\\', '/') AS path FROM p)
SELECT p_partkey, CASE WHEN starts_with(path, '/media/tv/') THEN substr(path, 11) WHEN starts_with(path, '/media/') THEN substr(path, 8) ELSE path END AS path FROM q""")
def _(t):
    k = F.col("p_size") % 3
    path = F.when(k == 0, F.concat(F.lit("/media/tv/"), "p_name")).when(k == 1, F.concat(F.lit("/media\\"), "p_brand")).otherwise(F.concat(F.lit("/other/"), "p_name"))
    return t("part").select("p_partkey", T.canonical_path(path, ["/media", "/media/tv/"]).alias("path"))


@query("path_hashes", """
WITH b AS (SELECT p_partkey, list_transform(string_split(p_name || p_partkey, ''), lambda c: CAST(ord(c) AS HUGEINT)) AS b FROM part)
SELECT p_partkey, lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), b), lambda h, c: (xor(h, c) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS UBIGINT))), 16, '0') AS hash FROM b""")
def _(t):
    return t("part").select("p_partkey", T.fnv1a(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("hash"))


# Cases by the number of a row; the answers are those of the rule, spelt out for each case.
_HEADERS = {"0": 1.0, "junk": 60.0, " 30 ": 30.0, "121": None, "30.5": 30.5, "-5": 1.0, "1e2": 100.0, "120": 120.0, "inf": None, "NaN": 60.0, "2d": 60.0, "": 60.0}


@query("retry_after", "SELECT p_partkey, CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else f'{v}e0'}" for k, v in enumerate(_HEADERS.values())) + " ELSE least(p_size * 2e0 + 25e-2, 120e0) END AS seconds FROM part")
def _(t):
    header = F.get(F.array(*[F.lit(h) for h in _HEADERS]), (F.col("p_partkey") % 13).cast("int"))
    return t("part").select("p_partkey", T.retry_after(F.coalesce(header, (F.col("p_size") * 2 + 0.25).cast("string"))).alias("seconds"))


@query("is_before", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE ts < TIMESTAMP '2024-02-01 10:00:00' END AS before FROM events")
def _(t):
    stamp = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    return t("events").select("event_id", changes.is_before(stamp, F.lit("2024-02-01T12:00:00+02:00")).alias("before"))


@query("robots", """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (regexp_matches(path, '^/fr/') AND NOT regexp_matches(path, '^/fr/.*5$')) AND NOT regexp_matches(path, '^/.*7$') AS allowed FROM p""")
def _(t):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return t("pages").select("page_id", T.robots_allowed(path, ["/fr/*5$"], ["/fr/", "/*7$"]).alias("allowed"))


@query("decoded_urls", "SELECT page_id, url_decode(replace(url, '/en/', '/%C3%A9n+%2F')) AS url FROM pages")
def _(t):
    return t("pages").select("page_id", T.percent_plain(F.replace("url", F.lit("/en/"), F.lit("/%C3%A9n+%2F"))).alias("url"))


@query("tag_roles", """
WITH p AS (SELECT p_partkey, ['Setting-Time', 'Setting-Universe-Space', 'Theme-Drama', 'Cast-Main-Lead', 'Sexual Content'][1 + p_size % 5] AS c FROM part)
SELECT p_partkey, CASE c WHEN 'Setting-Time' THEN 'era' WHEN 'Setting-Universe-Space' THEN 'region' WHEN 'Theme-Drama' THEN 'theme' WHEN 'Cast-Main-Lead' THEN 'character_trait' END AS role FROM p""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("Setting-Time", "Setting-Universe-Space", "Theme-Drama", "Cast-Main-Lead", "Sexual Content")])
    category = F.get(names, F.col("p_size") % 5)
    return t("part").select("p_partkey", T.role_of(category, {"Setting": "region", "Setting-Time": "era", "Theme": "theme", "Cast": "character_trait"}).alias("role"))


@query("json_values", """
WITH v AS (SELECT event_id, ['0', '12', '-3.0', 'true', 'false', 'null', '""', '"x"', '[]', '{"a":1}'][1 + event_id % 10] AS v FROM events)
SELECT event_id, v IN ('12', '-3.0', 'true', '"x"', '{"a":1}') AS truthy, CASE v WHEN '0' THEN 0 WHEN '12' THEN 12 WHEN '-3.0' THEN -3 WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS number FROM v""")
def _(t):
    value = F.get(F.array(*[F.lit(x) for x in ("0", "12", "-3.0", "true", "false", "null", '""', '"x"', "[]", '{"a":1}')]), (F.col("event_id") % 10).cast("int"))
    return t("events").select("event_id", T.truthy(value).alias("truthy"), T.as_int(value).cast("int").alias("number"))


# Lines of a decoder's log, and whether each tells of damage.
_LOG = {
    "[hevc @ 0x5] cu_chroma_qp_offset 5 outside the valid range": True,
    "  [h264 @ 0x1] Error while decoding MB 1": True,
    "[mp3 @ 0x2] Invalid data found": False,
    "[hevc @ 0x5] Failed setup for format cuda: invalid": False,
    "[av1_cuvid @ 0x9] concealing 4 errors": True,
    "[hevc] error": False,
    "[vp9 @ 0x3] a warning": False,
    "error while decoding": False,
}
_SQL_LOG = "list_filter([" + ", ".join(f"CASE WHEN (event_id + {k}) % 3 = 0 THEN {1 if v else 0} END" for k, v in enumerate(_LOG.values())) + "], lambda x: x IS NOT NULL)"


@query("decode_damage", f"SELECT event_id, CAST(list_sum({_SQL_LOG}) AS BIGINT) AS damage, CAST(len({_SQL_LOG}) - list_sum({_SQL_LOG}) AS BIGINT) AS other FROM events")
def _(t):
    lines = F.array(*[F.when((F.col("event_id") + k) % 3 == 0, F.lit(x)) for k, x in enumerate(_LOG)])
    found = T.decoder_lines(F.array_join(F.array_compact(lines), "\r\n \n"))
    return t("events").select("event_id", found.alias("f")).select("event_id", F.size("f.damage").cast("long").alias("damage"), "f.other")


