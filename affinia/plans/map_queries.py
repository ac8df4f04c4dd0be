"""Queries of the drawn map, of exact sums and draws, and of a store's versions.

Embeddings are titles placed by their first two numbers, an order's brands are tags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from affinia.operators import exact, layout, ranking, regions, tags, vectors
from affinia.operators.shared import shared_path, stored
from affinia.plans.catalogue import _AXES, _frames, query
from affinia.sources.store import Store

EXCLUDED = ("Brand#7",)


def _points(t):
    return t("embeddings").select(F.col("vec_id").alias("item"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def _tags(t):
    """item, tag: brand and type of the parts of the order with a point's number."""
    lines = t("lineitem").select(F.col("l_orderkey").alias("item"), "l_partkey").join(t("embeddings").select(F.col("vec_id").alias("item")), "item", "left_semi")
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), F.array("p_brand", F.concat("p_brand", F.lit(" "), "p_type")).alias("tags"))
    return lines.join(parts, "l_partkey").select("item", F.explode("tags").alias("tag")).distinct()


def _tree_sql() -> str:
    """The split and the names, a table for each level."""
    first, last, least = regions.FIRST, regions.LAST, regions.LEAST
    out = [
        "p AS (SELECT vec_id AS item, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)",
        """r AS (SELECT DISTINCT l_orderkey AS item, unnest([p_brand, p_brand || ' ' || p_type]) AS tag FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT item FROM p))""",
        "l0 AS (SELECT item, x, y, CAST(0 AS BIGINT) AS node, count(*) OVER () AS n FROM p)",
    ]
    for k in range(last):
        out.append(f"""v{k} AS (SELECT *, CASE WHEN max(x) OVER c - min(x) OVER c >= max(y) OVER c - min(y) OVER c THEN x ELSE y END AS v FROM l{k} WHERE n >= {least} WINDOW c AS (PARTITION BY node)),
        h{k} AS (SELECT item, x, y, 2 * node + 1 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY v, item) > n // 2 THEN 1 ELSE 0 END AS node FROM v{k}),
        l{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM h{k})""")
    levels = " UNION ALL ".join(f"SELECT *, {k} AS depth FROM l{k} WHERE n >= {least}" for k in range(first, last + 1))
    out.append(f"g AS ({levels})")
    out.append("d AS (SELECT tag, count(*) AS df FROM r GROUP BY tag), m AS (SELECT count(DISTINCT item) AS titles FROM r)")
    skip = ", ".join(f"'{x}'" for x in EXCLUDED)
    out.append(f"""c AS (SELECT node, any_value(depth) AS depth, tag, count(*) AS k, any_value(n) AS n FROM g JOIN r USING (item) GROUP BY node, tag),
        q AS (SELECT node, depth, tag, k * (1 + ln(titles * 1e0 / df)) AS score FROM c JOIN d USING (tag), m WHERE df >= 2 AND tag NOT IN ({skip}) AND k >= greatest(2e0, 5e-2 * n))""")
    out.append(f"u{first - 1} AS (SELECT CAST(NULL AS BIGINT) AS node, CAST(NULL AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS tag WHERE false)")
    for k in range(first, last + 1):
        out.append(f"""n{k} AS (SELECT a.node, coalesce(any_value(u.used), []) AS used FROM (SELECT DISTINCT node FROM g WHERE depth = {k}) a LEFT JOIN u{k - 1} u ON u.node = (a.node - 1) // 2 GROUP BY a.node),
        b{k} AS (SELECT q.node, q.tag FROM q JOIN n{k} USING (node) WHERE NOT list_contains(used, tag) QUALIFY row_number() OVER (PARTITION BY q.node ORDER BY score DESC, tag) = 1),
        u{k} AS (SELECT n.node, CASE WHEN b.tag IS NULL THEN used ELSE list_append(used, b.tag) END AS used, b.tag FROM n{k} n LEFT JOIN b{k} b USING (node))""")
    out.append("names AS (" + " UNION ALL ".join(f"SELECT node, tag FROM u{k} WHERE tag IS NOT NULL" for k in range(first, last + 1)) + ")")
    return "WITH " + ",\n".join(out)


_SPAN = "list_sort(list({0}))[CAST(floor(9e-1 * (count(*) - 1)) AS BIGINT) + 1] - list_sort(list({0}))[CAST(floor(1e-1 * (count(*) - 1)) AS BIGINT) + 1]"


@query("region_labels", f"""{_tree_sql()}
SELECT node, round(list_sort(list(x))[count(*) // 2 + 1], 4) AS x, round(list_sort(list(y))[count(*) // 2 + 1], 4) AS y,
       round({_SPAN.format("x")}, 4) AS width, round({_SPAN.format("y")}, 4) AS height, count(*) AS titles, any_value(tag) AS tag
FROM g JOIN names USING (node) GROUP BY node""")
def _(t):
    return regions.region_labels(_points(t), _tags(t), EXCLUDED)


@query("labelled_points", f"""{_tree_sql()}, f AS (SELECT item, max(node) AS node FROM g JOIN names USING (node) GROUP BY item)
SELECT p.item, f.node, names.tag FROM p LEFT JOIN f USING (item) LEFT JOIN names ON names.node = f.node""")
def _(t):
    return regions.labelled_points(_points(t), _tags(t), EXCLUDED)


# --- layout, exact sums, draws -----------------------------------------------------------------------


def _vocabulary(t):
    """tag, column: names with brands, in order."""
    named = t("part").select(F.concat("p_name", F.lit("/"), "p_brand").alias("tag")).distinct()
    return ranking.placed_in_group(named, [], [F.col("tag")], "column").select("tag", "column")


# SplitMix64 in numbers of 128 bits, cut to 64.
_CUT = "CAST(({0}) % 18446744073709551616 AS UBIGINT)"
_MUL = lambda a, b: _CUT.format(f"CAST({a} AS UHUGEINT) * {b}")


@query("sign_words", f"""
WITH t AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS "column" FROM (SELECT DISTINCT p_name || '/' || p_brand AS tag FROM part)),
     s AS (SELECT tag, "column", word, {_CUT.format(f"CAST(xor(CAST(1 AS UBIGINT), {_MUL('"column"', layout.STEP)}) AS UHUGEINT) + CAST(word + 1 AS UHUGEINT) * {layout.STEP}")} AS z FROM t, (SELECT unnest([0, 1, 2, 3]) AS word)),
     a AS (SELECT *, {_MUL("xor(z, z >> 30)", layout.FIRST_FACTOR)} AS y FROM s), b AS (SELECT *, {_MUL("xor(y, y >> 27)", layout.SECOND_FACTOR)} AS x FROM a)
SELECT tag, "column", CAST(word AS INTEGER) AS word, lpad(lower(to_hex(xor(x, x >> 31))), 16, '0') AS bits FROM b""")
def _(t):
    return layout.sign_table(_vocabulary(t))


def _near(tagged):
    """item, other, weight: the nearest titles by their tags. tagged: item, tag."""
    return tags.nearest_titles(tagged.withColumnRenamed("item", "title")).select(F.col("title").alias("item"), "other", F.col("cosine").alias("weight"))


@query("title_map")
def _(t):
    tagged = stored(_tags(t), "tags")
    return layout.title_map(tagged, _near(tagged), EXCLUDED)


@query("pairwise_norms", "SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def _(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.round(exact.pairwise_norm("embedding").cast("double"), 4).alias("norm"))


@query("tree_sums", "SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(t):
    return exact.tree_sums(t("events"), ["event_type"], [F.col("event_id")], "value").select("event_type", F.round("total", 4).alias("total"))


@query("sequential_draw")
def _(t):
    scored = vectors.softmax(vectors.shot_scores(_frames(t), _AXES[0]), 0.1)
    return exact.sequential_draw(scored, 10, 7, [F.desc("score"), F.asc("item"), F.asc("shot")]).select("item", "shot", "score", "pick")


# --- versions of a store -----------------------------------------------------------------------------


def _items(t):
    n, brand = F.col("p_size"), F.col("p_brand")
    return t("part").select(F.concat(F.lit("i"), F.col("p_partkey")).alias("item_id"), F.lit("movie").alias("type"), F.col("p_name").alias("title"), F.lower("p_name").alias("sort_title"), (n + 1950).alias("year"), F.lit(None).cast("string").alias("show_item_id"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"), F.lit(None).cast("long").alias("duration_ms"), brand.alias("library"))


def _edges(t):
    return t("part").select(F.concat(F.lit("i"), F.col("p_partkey")).alias("from_id"), F.concat(F.lit("i"), F.floor(F.col("p_partkey") / 2)).alias("to_id"), F.lit("similar").alias("edge_type"), F.col("p_size").alias("rank"))


@query("store_versions", """
WITH n AS (SELECT count(*) AS parts, count(*) FILTER (p_size > 25) AS small FROM part)
SELECT unnest(['first', 'same', 'edges changed', 'shrink refused', 'shrink stated', 'rolled back']) AS step, unnest([1, 1, 2, 2, 3, 4]) AS version,
       unnest(['edges,items', '', 'edges', 'refused', 'items', 'edges,items']) AS written, unnest([parts, parts, parts, parts, small, parts]) AS items, unnest([parts, parts, small, small, small, parts]) AS edges FROM n""")
def _(t):
    """A store through two publications, one without a change, a refused and a stated loss of rows, and a way back."""
    items, edges = _items(t), _edges(t)
    few_items, few_edges = items.where("year > 1975"), edges.where("rank > 25")
    store = Store(items.sparkSession, shared_path(items.sparkSession, "store"))
    rows = []

    def note(step: str, written: str) -> None:
        rows.append((step, store.versions()[-1], written, store.table("items").count(), store.table("edges").count()))

    for step, tables in (("first", {"items": items, "edges": edges}), ("same", {"items": items.repartition(3), "edges": edges}), ("edges changed", {"items": items, "edges": few_edges})):
        note(step, ",".join(store.publish_changed(tables)[1]))
    try:
        store.publish_changed({"items": few_items})
    except ValueError:
        note("shrink refused", "refused")
    note("shrink stated", ",".join(store.publish_changed({"items": few_items}, shrink={"items": few_items.count()})[1]))
    store.rollback(1)
    note("rolled back", ",".join(sorted(store.check_shape()["tables"])) if not store.damaged() else "damaged")
    return items.sparkSession.createDataFrame(rows, "step string, version int, written string, items long, edges long")
