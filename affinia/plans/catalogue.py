"""The registered queries: each operator on the driver's tables, with the same in DuckDB SQL.

Stand-ins: a customer is an account, a brand a show, a size a season, a part an episode, an order a title,
a brand on it a tag, a supplier's nation an edge's start, events a log, embeddings the frames of titles
(label) in time order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinia.functions import text as T
from affinia.operators import cells, changes, clusters, matching, ranking, tags, taste, timeline, vectors
from affinia.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- stand-ins ---------------------------------------------------------------------------------------


def _plays(t) -> DataFrame:
    ordered = t("orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    parts = t("part").select("p_partkey", F.col("p_brand").alias("unit"))
    return ordered.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey")).select("account", "unit")


def _episodes(t) -> DataFrame:
    return t("part").select(F.col("p_brand").alias("unit"), F.col("p_size").alias("season"), F.col("p_partkey").alias("episode"))


def _attributes(t) -> DataFrame:
    return t("part").select(F.col("p_brand").alias("unit"), F.lit("part").alias("namespace"), F.lit("type").alias("key"), F.col("p_type").alias("value")).distinct()


def _tagged(t) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("title"), "l_partkey")
    parts = t("part").select("p_partkey", F.col("p_brand").alias("tag"))
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select("title", "tag").distinct()


def _fine_lines(t) -> DataFrame:
    """Supplier as title, part name with brand as tag, once for each line."""
    lines = t("lineitem").select(F.col("l_suppkey").alias("title"), "l_partkey")
    parts = t("part").select("p_partkey", F.concat("p_name", F.lit("/"), "p_brand").alias("tag"))
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select("title", "tag")


def _fine_tagged(t) -> DataFrame:
    return _fine_lines(t).distinct()


def _frames(t) -> DataFrame:
    return t("embeddings").select(F.col("label").cast("long").alias("item"), F.floor(F.col("vec_id") / 5).alias("shot"), (F.col("vec_id") * 1000).alias("t_ms"), F.col("embedding").alias("vector"))


_T = "SELECT DISTINCT l_orderkey AS title, p_brand AS tag FROM lineitem JOIN part ON p_partkey = l_partkey"
_FT = "SELECT DISTINCT l_suppkey AS title, p_name || '/' || p_brand AS tag FROM lineitem JOIN part ON p_partkey = l_partkey"
_PLAYS = "SELECT o_custkey AS account, p_brand AS unit FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
_LEN = "SELECT unit, list_sort(list(n))[len(list(n)) // 2 + 1] AS season_length FROM (SELECT p_brand AS unit, p_size AS season, count(DISTINCT p_partkey) AS n FROM part WHERE p_size IS NOT NULL GROUP BY ALL) GROUP BY unit"
_ATTR = "SELECT DISTINCT p_brand AS unit, 'part' AS namespace, 'type' AS key, p_type AS value FROM part"

# --- taste -------------------------------------------------------------------------------------------


@query("season_length", _LEN)
def _(t):
    return taste.season_lengths(_episodes(t))


@query("taste_rollup", f"""
WITH p AS (SELECT account, unit, count(*) AS plays FROM ({_PLAYS}) GROUP BY ALL),
     r AS (SELECT account, unit, plays * 1e0 / coalesce(season_length, 1) AS r FROM p LEFT JOIN ({_LEN}) USING (unit)),
     a AS ({_ATTR}), n AS (SELECT unit, count(*) AS n FROM a GROUP BY unit)
SELECT account, namespace, key, value, round(sum(sqrt(r) / n), 6) AS weight FROM r JOIN n USING (unit) JOIN a USING (unit) WHERE r >= 0.5 GROUP BY ALL""")
def taste_rollup(t):
    return taste.taste(_plays(t), _episodes(t), _attributes(t)).withColumn("weight", F.round("weight", 6))


@query("taste_pooled", f"""
WITH p AS (SELECT unit, count(*) AS plays FROM ({_PLAYS}) GROUP BY ALL),
     r AS (SELECT unit, plays * 1e0 / coalesce(season_length, 1) AS r FROM p LEFT JOIN ({_LEN}) USING (unit)),
     a AS ({_ATTR}), n AS (SELECT unit, count(*) AS n FROM a GROUP BY unit)
SELECT namespace, key, value, round(sum(sqrt(r) / n), 4) AS weight FROM r JOIN n USING (unit) JOIN a USING (unit) WHERE r >= 0.5 GROUP BY ALL""")
def _(t):
    return taste.pooled_taste(_plays(t), _episodes(t), _attributes(t)).withColumn("weight", F.round("weight", 4))


@query("watched_units", f"""
WITH p AS (SELECT account, unit, count(*) AS plays FROM ({_PLAYS}) GROUP BY ALL)
SELECT account, unit FROM p LEFT JOIN ({_LEN}) USING (unit) WHERE plays * 1e0 / coalesce(season_length, 1) >= 0.5""")
def _(t):
    return taste.watched_units(_plays(t), taste.season_lengths(_episodes(t)))


@query("account_plays", "SELECT user_id AS account, count(*) AS plays, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy(F.col("user_id").alias("account")).agg(F.count(F.lit(1)).alias("plays"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


# --- tags --------------------------------------------------------------------------------------------


@query("tag_frequencies", f"WITH t AS ({_T}), n AS (SELECT count(DISTINCT title) AS n FROM t) SELECT tag, count(*) AS df, round(1 + ln(any_value(n) * 1e0 / count(*)), 4) AS idf FROM t, n GROUP BY tag")
def _(t):
    return tags.frequencies(_tagged(t)).withColumn("idf", F.round("idf", 4))


_PAIRS = "SELECT x.tag AS a, y.tag AS b, count(*) AS shared FROM t x JOIN t y ON x.title = y.title AND x.tag <> y.tag GROUP BY ALL"


@query("tag_lift", f"""
WITH t AS ({_T}), d AS (SELECT tag, count(*) AS df FROM t GROUP BY tag), n AS (SELECT count(DISTINCT title) AS n FROM t), p AS ({_PAIRS}),
     l AS (SELECT a AS tag, b AS other, shared, round((shared * 1e0 / da.df + 4e0 / (2 * da.df) - 2e0 * sqrt((shared * 1e0 / da.df * (1 - shared * 1e0 / da.df) + 4e0 / (4 * da.df)) / da.df)) / (1 + 4e0 / da.df) * n / db.df, 6) AS lift
           FROM p JOIN d da ON da.tag = a JOIN d db ON db.tag = b, n)
SELECT *, row_number() OVER (PARTITION BY tag ORDER BY lift DESC, shared DESC, other) AS place FROM l WHERE lift > 1 QUALIFY place <= 5""")
def _(t):
    return tags.lifted(_tagged(t))


@query("co_tags", f"WITH t AS ({_T}), d AS (SELECT tag, count(*) AS df FROM t GROUP BY tag), p AS ({_PAIRS}) SELECT b AS other, shared, df FROM p JOIN d ON tag = b WHERE a = 'Brand#7'")
def _(t):
    return tags.co_tags(_tagged(t), "Brand#7")


@query("tag_network", f"""
WITH t AS ({_T}), d AS (SELECT tag FROM t GROUP BY tag HAVING count(*) >= 3), p AS ({_PAIRS}),
     r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS place FROM p WHERE a IN (FROM d) AND b IN (FROM d))
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, shared FROM r WHERE place <= 6""")
def _(t):
    return tags.network(_tagged(t))


@query("tag_neighbours", f"""
WITH t AS ({_T}), p AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS place FROM p),
     e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, shared FROM r WHERE place <= 6)
SELECT CASE WHEN a = 'Brand#7' THEN b ELSE a END AS other, shared FROM e WHERE a = 'Brand#7' OR b = 'Brand#7'""")
def _(t):
    return matching.either_end(tags.network(_tagged(t), least_df=1), "Brand#7")


@query("nearest_titles", f"""
WITH t AS ({_FT}), n AS (SELECT count(DISTINCT title) AS n FROM t), d AS (SELECT tag, 1 + ln(any_value(n) * 1e0 / count(*)) AS idf FROM t, n GROUP BY tag),
     w AS (SELECT title, tag, idf, sqrt(sum(idf * idf) OVER (PARTITION BY title)) AS norm FROM t JOIN d USING (tag)),
     s AS (SELECT x.title, y.title AS other, round(sum(x.idf / x.norm * (y.idf / y.norm)), 6) AS cosine FROM w x JOIN w y ON x.tag = y.tag AND x.title <> y.title GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY title ORDER BY cosine DESC, other) AS place FROM s WHERE cosine > 0 QUALIFY place <= 12""")
def _(t):
    return tags.nearest_titles(_fine_lines(t))


@query("list_overrepresented", f"""
WITH t AS ({_FT}), l AS (SELECT DISTINCT s_nationkey AS list, s_suppkey AS title FROM supplier), n AS (SELECT count(DISTINCT title) AS n FROM t),
     z AS (SELECT list, count(*) AS size FROM l GROUP BY list), d AS (SELECT tag, count(*) AS df FROM t GROUP BY tag),
     i AS (SELECT list, tag, count(*) AS in_list FROM l JOIN t USING (title) GROUP BY ALL HAVING count(*) >= 2),
     x AS (SELECT list, tag, in_list, round(in_list * 1e0 / size / (df * 1e0 / n), 6) AS lift FROM i JOIN z USING (list) JOIN d USING (tag), n)
SELECT *, row_number() OVER (PARTITION BY list ORDER BY lift DESC, in_list DESC, tag) AS place FROM x WHERE lift >= 1.2 QUALIFY place <= 20""")
def _(t):
    lists = t("supplier").select(F.col("s_nationkey").alias("list"), F.col("s_suppkey").alias("title")).distinct()
    return tags.overrepresented(lists, _fine_tagged(t), least_in_list=2, least_lift=1.2)


@query("list_summary", """
SELECT p_type AS list, count(DISTINCT p_partkey) AS entries, count(DISTINCT l_partkey) AS owned, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS watched
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type""")
def _(t):
    lines = t("lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("seen"))
    joined = t("part").select("p_partkey", "p_type").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy(F.col("p_type").alias("list")).agg(F.count(F.lit(1)).alias("entries"), F.count("l_partkey").alias("owned"), F.count(F.when(F.col("seen"), 1)).alias("watched"))


@query("keyword_profile", f"WITH t AS ({_T}) SELECT tag, count(*) AS titles, row_number() OVER (ORDER BY count(*) DESC, tag) AS place FROM t GROUP BY tag QUALIFY place <= 20")
def _(t):
    counted = _tagged(t).groupBy("tag").agg(F.count(F.lit(1)).alias("titles")).orderBy(F.desc("titles"), "tag").limit(20)
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("titles"), "tag")).cast("long"))  # 20 rows


@query("profile_overlap", """
WITH s AS (SELECT DISTINCT c_nationkey AS account, p_name || p_brand || p_size AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey),
     a AS (SELECT account, list(tag) AS tags FROM s GROUP BY account)
SELECT x.account AS a, y.account AS b, round(len(list_intersect(x.tags, y.tags)) * 1e0 / len(list_distinct(list_concat(x.tags, y.tags))), 6) AS overlap FROM a x JOIN a y ON x.account < y.account""")
def _(t):
    house = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    tag = F.concat("p_name", "p_brand", F.col("p_size").cast("string"))
    rows = house.join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", tag.alias("tag")), F.col("p_partkey") == F.col("l_partkey"))
    sets = rows.groupBy(F.col("c_nationkey").alias("account")).agg(F.collect_set("tag").alias("tags"))  # a house for each nation
    b = sets.toDF("b", "more")
    return sets.join(b, F.col("account") < F.col("b")).select(F.col("account").alias("a"), "b", F.round(tags.jaccard(F.col("tags"), F.col("more")), 6).alias("overlap"))


@query("film_suffix_pairs", "WITH k AS (SELECT DISTINCT p_name AS keyword FROM part UNION SELECT DISTINCT p_name || ' film' FROM part WHERE p_size % 2 = 0) SELECT y.keyword AS a, x.keyword AS b FROM k x JOIN k y ON y.keyword = x.keyword || ' film'")
def _(t):
    names = t("part").select(F.col("p_name").alias("keyword"))
    films = t("part").where("p_size % 2 = 0").select(F.concat("p_name", F.lit(" film")).alias("keyword"))
    return tags.film_suffix_pairs(names.union(films).distinct())


# --- vectors -----------------------------------------------------------------------------------------

_F = "SELECT CAST(label AS BIGINT) AS item, vec_id // 5 AS shot, vec_id * 1000 AS t_ms, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_COS = "list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"
_AXES = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(3)]


@query("shot_search", f"WITH f AS ({_F}) SELECT item, shot, round(max(v[1] / sqrt(list_dot_product(v, v))), 6) AS score FROM f GROUP BY ALL")
def _(t):
    return vectors.shot_scores(_frames(t), _AXES[0])


@query("shot_search_negatives", f"""
WITH f AS ({_F}), s AS (SELECT item, shot, max(v[1] / sqrt(list_dot_product(v, v))) AS p, greatest(max(v[2] / sqrt(list_dot_product(v, v))), max(v[3] / sqrt(list_dot_product(v, v)))) AS n FROM f GROUP BY ALL)
SELECT item, shot, round(p - 0.5 * n, 6) AS score FROM s""")
def _(t):
    return vectors.shot_scores(_frames(t), _AXES[0], _AXES[1:])


@query("shot_softmax", f"""
WITH f AS ({_F}), s AS (SELECT item, shot, round(max(v[1] / sqrt(list_dot_product(v, v))), 6) AS score FROM f GROUP BY ALL), e AS (SELECT *, exp((score - max(score) OVER ()) / 0.1) AS e FROM s)
SELECT item, shot, score, round(e / sum(e) OVER (), 9) AS probability FROM e""")
def _(t):
    return vectors.softmax(vectors.shot_scores(_frames(t), _AXES[0]), 0.1).withColumn("probability", F.round("probability", 9))


@query("shot_draw")
def _(t):
    return vectors.draw(vectors.shot_scores(_frames(t), _AXES[0]), 10, 7, 0.1, ["item", "shot"])


@query("match_statistics", f"""
WITH f AS ({_F}), s AS (SELECT item, round(max(v[1] / sqrt(list_dot_product(v, v))), 6) AS score FROM f GROUP BY item, shot)
SELECT item, count(*) AS n, round(median(score), 6) AS median, round(quantile_cont(score, 0.99), 6) AS p99, max(score) AS best FROM s GROUP BY item""")
def _(t):
    return vectors.match_statistics(vectors.shot_scores(_frames(t), _AXES[0]), ["item"])


@query("best_frame", f"""
WITH f AS ({_F}), s AS (SELECT item, t_ms, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS score FROM f)
SELECT item, t_ms, score FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, t_ms) = 1""")
def _(t):
    scored = _frames(t).select("item", "t_ms", F.round(vectors.cosine(F.col("vector"), vectors.constant(_AXES[0])), 6).alias("score"))
    best = scored.groupBy("item").agg(F.max(F.struct("score", (-F.col("t_ms")).alias("minus"))).alias("x"))
    return best.select("item", (-F.col("x.minus")).alias("t_ms"), F.col("x.score").alias("score"))


@query("peaks", f"""
WITH RECURSIVE f AS ({_F}), s AS (SELECT item, t_ms, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS score FROM f),
  k AS (SELECT item, t_ms, score, 1 AS place, [t_ms] AS kept FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, t_ms) = 1
        UNION ALL
        SELECT * FROM (SELECT s.item, s.t_ms, s.score, k.place + 1 AS place, list_append(k.kept, s.t_ms) AS kept FROM k JOIN s ON s.item = k.item AND len(list_filter(k.kept, lambda x: abs(x - s.t_ms) < 120000)) = 0 WHERE k.place < 4
        QUALIFY row_number() OVER (PARTITION BY s.item ORDER BY s.score DESC, s.t_ms) = 1))
SELECT item, t_ms, score, CAST(place AS BIGINT) AS place FROM k""")
def _(t):
    return vectors.peaks(_frames(t).select("item", "t_ms", F.round(vectors.cosine(F.col("vector"), vectors.constant(_AXES[0])), 6).alias("score")))


@query("chamfer_pairs", f"""
WITH f AS ({_F}), s AS (SELECT x.item AS a, y.item AS b, x.t_ms AS ta, y.t_ms AS tb, {_COS} AS s FROM f x JOIN f y ON x.item < y.item),
     l AS (SELECT a, b, avg(s) AS m FROM (SELECT a, b, ta, max(s) AS s FROM s GROUP BY ALL) GROUP BY a, b), r AS (SELECT a, b, avg(s) AS m FROM (SELECT a, b, tb, max(s) AS s FROM s GROUP BY ALL) GROUP BY a, b)
SELECT a, b, round(least(l.m, r.m), 6) AS score FROM l JOIN r USING (a, b)""")
def _(t):
    frames = _frames(t)
    items = frames.select("item").distinct()
    return vectors.chamfer(frames, items.toDF("a").join(items.toDF("b"), F.col("a") < F.col("b")))


@query("nearest_vectors", f"""
WITH f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT x.id, y.id AS other, round({_COS}, 6) AS cosine FROM f x JOIN f y ON x.id <> y.id)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM s WHERE cosine >= 0.3 QUALIFY place <= 10""")
def _(t):
    return vectors.nearest_vectors(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, 0.3)


@query("close_vectors", f"""
WITH f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT x.id, y.id AS other, round({_COS}, 6) AS cosine FROM f x JOIN f y ON x.id <> y.id)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM s WHERE cosine >= 0.4 QUALIFY place <= 10""")
def _(t):
    return cells.close_vectors(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, 0.4)


@query("quantized_agreement")
def _(t):
    base = t("embeddings").select(F.col("label").alias("item"), F.col("vec_id").alias("id"), "embedding")
    ranks = []
    for vector in (F.col("embedding"), vectors.quantized(F.col("embedding"))):
        scored = base.select("item", "id", vectors.cosine(vector, vectors.constant(_AXES[0])).alias("s"))
        ranks.append(ranking.top_per_group(scored, ["item"], [F.desc("s"), F.asc("id")], 10))
    return vectors.ranking_agreement(ranks[0], ranks[1], "item", 10)


@query("norms", "SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def _(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


# --- time --------------------------------------------------------------------------------------------

_CUTS = "SELECT user_id AS item, list_sort(list((epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01')) // 10000)) AS cuts FROM events GROUP BY user_id"
_SHOTS = f"""
WITH RECURSIVE c AS ({_CUTS}), d AS (SELECT item, list_filter(cuts, lambda x: x < 1000000) AS cuts FROM c),
  k AS (SELECT item, cuts, 1 AS i, CAST(0 AS BIGINT) AS last, true AS kept FROM d
        UNION ALL SELECT item, cuts, i + 1, CASE WHEN cuts[i] - last >= 500 THEN cuts[i] ELSE last END, cuts[i] - last >= 500 FROM k WHERE i <= len(cuts)),
  e AS (SELECT item, last AS start_ms, lead(last, 1, 1000000) OVER (PARTITION BY item ORDER BY last) AS end_ms FROM k WHERE kept)
SELECT item, row_number() OVER (PARTITION BY item ORDER BY start_ms) - 1 AS shot, start_ms, end_ms FROM e"""


def _titles(t) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t("events").groupBy(F.col("user_id").alias("item")).agg(F.collect_list(F.floor(ms / 10000)).alias("cuts")).withColumn("duration_ms", F.lit(1000000).cast("long"))


@query("shots", _SHOTS)
def _(t):
    return timeline.shots(_titles(t))


@query("shot_samples", f"""WITH s AS ({_SHOTS.strip()})
SELECT item, shot, unnest(CASE WHEN end_ms - start_ms <= 2000 THEN [start_ms + (end_ms - start_ms) // 2] ELSE range(start_ms + 1000, end_ms, 2000) END) AS t_ms FROM s""")
def _(t):
    return timeline.samples(timeline.shots(_titles(t)))


@query("event_islands", """
WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
     i AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island""")
def _(t):
    return timeline.islands(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type"))


@query("moving_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 4) AS mean FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 3)
    return t("events").select("event_id", F.round(F.avg("value").over(w), 4).alias("mean"))


_LR = """l AS (SELECT event_id AS left_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS right_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'click')"""


def _sides(t) -> tuple[DataFrame, DataFrame]:
    e = t("events").select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    return (e.where("event_type = 'purchase'").select(F.col("event_id").alias("left_id"), "user_id", "t"), e.where("event_type = 'click'").select(F.col("event_id").alias("right_id"), "user_id", "t"))


@query("nearest_in_time", f"""WITH {_LR} SELECT left_id, right_id, abs(r.t - l.t) AS delta FROM l JOIN r ON r.user_id = l.user_id AND abs(r.t - l.t) <= 900
QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY abs(r.t - l.t), r.t, right_id) = 1""")
def _(t):
    return matching.nearest_in_time(*_sides(t), ["user_id"])


@query("greedy_matches")
def _(t):
    return matching.greedy_matches(*_sides(t), ["user_id"])


@query("windowed_events", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


@query("event_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("freshness", "SELECT event_type, epoch_us(max(ts)) AS last_us, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-03') AS days, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-03') > 3 AS stale FROM events GROUP BY event_type")
def _(t):
    days = F.date_diff(F.lit("2024-02-03").cast("date"), F.max("ts").cast("date"))
    return t("events").groupBy("event_type").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"), days.cast("long").alias("days"), (days > 3).alias("stale"))


# --- joins, sets, pages ------------------------------------------------------------------------------


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages")))
def _(t):
    counts = [t(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n") for n in ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def _(t):
    return t("customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment").limit(1)


@query("ids_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(t):
    ids = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("included_rows", "SELECT c_custkey, coalesce(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), []) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    return t("customer").join(rows, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders"))


@query("keyset_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 11")
def _(t):
    return ranking.page(t("part").select("p_partkey", "p_name"), ["p_partkey"], [100], 10)


@query("composite_page", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey, l_suppkey) > (500, 3, 0, 0) ORDER BY ALL LIMIT 21")
def _(t):
    rows = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey")
    return ranking.page(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [500, 3, 0, 0], 20).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("substring_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ing%'")
def _(t):
    return t("part").where(F.col("p_name").ilike("%ing%")).select("p_partkey", "p_name")


@query("suggest", "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY lower(p_name) <> 're', NOT starts_with(lower(p_name), 're'), p_name LIMIT 20")
def _(t):
    return ranking.prefix_first(t("part").select("p_name").distinct(), "p_name", "re", F.asc("p_name")).limit(20)


@query("decision_filter", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' END AS decision FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    decision = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted")
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", decision.alias("decision"))


@query("semi_either", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity >= 50)")
def _(t):
    orders = t("orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    large = orders.join(t("lineitem").where("l_quantity >= 50").select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_custkey")
    return t("customer").join(urgent.union(large), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 40)")
def _(t):
    return t("part").join(t("lineitem").where("l_returnflag = 'R' AND l_quantity >= 40"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("edge_titles", """
WITH e AS (SELECT s_nationkey AS f, c_nationkey AS t, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT a.n_name AS from_name, b.n_name AS to_name, row_number() OVER (PARTITION BY f ORDER BY n DESC, t) AS rank FROM e JOIN nation a ON a.n_nationkey = f JOIN nation b ON b.n_nationkey = t""")
def _(t):
    lines = t("lineitem").select("l_suppkey", "l_orderkey")
    ends = lines.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("f")), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("t")), F.col("c_custkey") == F.col("o_custkey"))
    edges = ends.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "t")).cast("long"))
    a, b = t("nation").select(F.col("n_nationkey").alias("f"), F.col("n_name").alias("from_name")), t("nation").select(F.col("n_nationkey").alias("t"), F.col("n_name").alias("to_name"))
    return edges.join(a, "f").join(b, "t").select("from_name", "to_name", "rank")


@query("resolve_priority", """
WITH i AS (SELECT 'name' AS namespace, p_name AS value, p_type AS kind, min(p_partkey) AS item FROM part GROUP BY ALL UNION ALL SELECT 'brand', p_brand, p_type, min(p_partkey) FROM part WHERE p_size < 25 GROUP BY ALL),
     e AS (SELECT p_partkey AS entry, p_type AS kind, 'name' AS namespace, p_name || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END AS value FROM part UNION ALL SELECT p_partkey, p_type, 'brand', p_brand FROM part)
SELECT entry, e.kind, arg_min(item, CASE namespace WHEN 'brand' THEN 1 ELSE 2 END) AS item FROM e JOIN i USING (namespace, value, kind) GROUP BY ALL""")
def _(t):
    p = t("part")
    row = lambda ns, v, df: df.select(F.lit(ns).alias("namespace"), F.col(v).alias("value"), F.col("p_type").alias("kind"), "p_partkey")
    ids = row("name", "p_name", p).union(row("brand", "p_brand", p.where("p_size < 25"))).groupBy("namespace", "value", "kind").agg(F.min("p_partkey").alias("item"))
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "!").otherwise(""))
    entries = row("name", "p_name", p.withColumn("p_name", name)).union(row("brand", "p_brand", p)).withColumnRenamed("p_partkey", "entry")
    return matching.resolved(entries, ids, ["brand", "name"])


@query("name_join", """
WITH a AS (SELECT c_custkey AS id, substr(c_name, 10) AS name FROM customer), b AS (SELECT s_suppkey + 5 AS id, substr(s_name, 10) AS name FROM supplier)
SELECT a.id AS left_id, b.id AS right_id, coalesce(a.name, b.name) AS name FROM (SELECT * FROM a WHERE id <> 0) a FULL JOIN (SELECT * FROM b WHERE id <> 0) b ON a.name = b.name""")
def _(t):
    number = lambda c: F.substring(c, 10, 99).alias("name")
    a = t("customer").select(F.col("c_custkey").alias("id"), number("c_name"))
    b = t("supplier").select((F.col("s_suppkey") + 5).alias("id"), number("s_name"))
    return matching.named_alike(a, b)


@query("vocabulary", "SELECT p_brand AS word FROM part UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer")
def _(t):
    return t("part").select(F.col("p_brand").alias("word")).union(t("part").select("p_type")).union(t("customer").select("c_mktsegment")).distinct()


@query("set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).subtract(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("duplicates", "SELECT p_name, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys FROM part GROUP BY p_name HAVING count(*) > 1")
def _(t):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return t("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), keys.alias("keys")).where("n > 1")


@query("first_occurrence", "SELECT p_name, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1")
def _(t):
    return t("part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("p_partkey"))


@query("nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id")
def _(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").orderBy(F.asc_nulls_last("quality"), "doc_id")


@query("offset_page", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def _(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(25)


@query("numeric_order", "SELECT k, row_number() OVER (ORDER BY NOT regexp_full_match(k, '[0-9]+'), TRY_CAST(k AS BIGINT), k) AS place FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS k FROM part UNION SELECT DISTINCT p_type FROM part)")
def _(t):
    keys = t("part").select(F.col("p_size").cast("string").alias("k")).union(t("part").select("p_type")).distinct()
    digits = F.col("k").rlike("^[0-9]+$")
    placed = ranking.placed_in_group(keys, [], [~digits, F.when(digits, F.col("k").cast("long")), F.col("k")])
    return placed.select("k", (F.col("place") + 1).alias("place"))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("json_field", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


# --- changes, groups, text ---------------------------------------------------------------------------


@query("upsert", "WITH n AS (SELECT p_partkey * 2 AS k, p_retailprice + 1 AS price FROM part) SELECT p_partkey, p_retailprice AS price FROM part WHERE p_partkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, price FROM n")
def _(t):
    old = t("part").select("p_partkey", F.col("p_retailprice").alias("price"))
    new = t("part").select((F.col("p_partkey") * 2).alias("p_partkey"), (F.col("p_retailprice") + 1).alias("price"))
    return changes.upserted(old, new, ["p_partkey"])


@query("slice_replace", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7) UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size = 7")
def _(t):
    part = t("part").select("p_partkey", "p_brand", "p_size")
    return changes.slice_replaced(part, part.where("p_size = 7"), ["p_brand"]).select("p_partkey", "p_brand")


@query("latest_decision", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def _(t):
    return changes.latest(t("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("due_refresh", """
WITH c AS (SELECT user_id, max(ts) AS fetched FROM events WHERE event_type = 'view' AND user_id % 4 <> 0 GROUP BY user_id), s AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, epoch_us(fetched) AS fetched_us FROM s LEFT JOIN c USING (user_id) WHERE fetched IS NULL OR fetched < TIMESTAMP '2024-03-14' - INTERVAL 45 DAYS""")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    cursors = e.where("event_type = 'view' AND user_id % 4 <> 0").groupBy("user_id").agg(F.max("ts").alias("fetched_at")).withColumn("attempted_at", F.col("fetched_at"))
    return changes.due(e.select("user_id").distinct(), cursors, "user_id", F.lit("2024-03-14 00:00:00").cast("timestamp")).select("user_id", F.unix_micros("fetched_at").alias("fetched_us"))


@query("file_changes")
def _(t):
    files = t("part").select(F.concat(F.lit("/a/"), "p_partkey").alias("path"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("mtime"), F.col("p_name").alias("hash"))
    return changes.file_changes(files.where("size > 10"), files.where("size < 40"))


@query("backoff", "SELECT p_size AS failures, CAST(least(3600 * power(2, p_size - 1), 86400) AS BIGINT) AS seconds FROM (SELECT DISTINCT p_size FROM part)")
def _(t):
    return t("part").select(F.col("p_size").alias("failures")).distinct().select("failures", changes.backoff_seconds(F.col("failures")).alias("seconds"))


@query("ordered_digest", """
WITH h AS (SELECT p_brand, p_partkey, sha256(strlen(p_partkey::VARCHAR) || ':' || p_partkey || strlen(p_name) || ':' || p_name || strlen(p_size::VARCHAR) || ':' || p_size) AS h FROM part)
SELECT p_brand, sha256(string_agg(h, '' ORDER BY p_partkey)) AS digest FROM h GROUP BY p_brand""")
def _(t):
    return changes.fingerprint(t("part"), ["p_partkey", "p_name", "p_size"], ["p_brand"], ["p_partkey"])


@query("table_digest", """
WITH h AS (SELECT p_brand, p_partkey, sha256(strlen(p_name) || ':' || p_name) AS h FROM part), g AS (SELECT p_brand, sha256(string_agg(h, '' ORDER BY p_partkey)) AS d FROM h GROUP BY p_brand)
SELECT sha256(string_agg(d, '' ORDER BY p_brand)) AS digest FROM g""")
def _(t):
    return changes.table_digest(changes.fingerprint(t("part"), ["p_name"], ["p_brand"], ["p_partkey"]), ["p_brand"])


@query("decision_bucket", """
WITH s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND doc_id % 5 = 0 THEN 'accepted' END AS decision, (doc_id % 100) / 1e2 AS score FROM labels)
SELECT doc_id, CASE WHEN decision = 'accepted' THEN 'merged' WHEN decision = 'rejected' THEN 'rejected' WHEN score >= 0.9 THEN 'merged' WHEN score >= 0.5 THEN 'proposed' END AS bucket FROM s""")
def _(t):
    decision = F.when(F.col("toxic") == 1, "rejected").when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), "accepted")
    rows = t("labels").select("doc_id", decision.alias("decision"), (F.col("doc_id") % 100 / 100).alias("score"))
    return rows.select("doc_id", clusters.decision_bucket().alias("bucket"))


@query("merge_groups", """
WITH RECURSIVE e AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 5 = 0 THEN p_partkey // 25 * 25 ELSE p_partkey // 5 * 5 END AS b FROM part WHERE p_partkey % 25 <> 0),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS seen FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen)
SELECT node, min(seen) AS root FROM w GROUP BY node""")
def _(t):
    k = F.col("p_partkey")
    edges = t("part").select(k.alias("a"), F.when(k % 5 == 0, F.floor(k / 25) * 25).otherwise(F.floor(k / 5) * 5).alias("b"))
    return clusters.components(edges.where("a <> b"))


@query("merge_map")
def _(t):
    words = t("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("titles")).select(F.col("p_name").alias("keyword"), "titles")
    pairs = clusters.similar_pairs(words, 0.6)
    return clusters.merge_map(pairs.withColumn("decision", F.lit(None).cast("string")), words, accept=0.6)


@query("similar_pairs", """
WITH w AS (SELECT DISTINCT p_name || ' ' || p_type AS k FROM part) SELECT x.k AS a, y.k AS b, round(1 - levenshtein(x.k, y.k) * 1e0 / greatest(length(x.k), length(y.k)), 6) AS score
FROM w x JOIN w y ON x.k < y.k WHERE 1 - levenshtein(x.k, y.k) * 1e0 / greatest(length(x.k), length(y.k)) + 1e-9 >= 0.7""")
def _(t):
    words = t("part").select(F.concat("p_name", F.lit(" "), "p_type").alias("keyword")).distinct()
    return clusters.similar_pairs(words, 0.7).withColumn("score", F.round("score", 6))


@query("device_clusters")
def _(t):
    plays = t("events").select(F.col("user_id").alias("account"), F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("device"), F.concat(F.col("user_id").cast("string"), F.lit("."), F.get_json_object("props", "$.k")).alias("ip"))
    return clusters.device_clusters(plays)


@query("surface", "SELECT DISTINCT trim(regexp_replace(lower(p_name || '   ' || p_brand), '\\s+', ' ', 'g')) AS surface FROM part")
def _(t):
    return t("part").select(T.surface(F.concat("p_name", F.lit("   "), "p_brand")).alias("surface")).distinct()


@query("keyword_forms")
def _(t):
    words = t("documents").select(F.explode(F.split("text", r"[ \n]+")).alias("raw")).distinct()
    return words.select("raw", T.keyword(F.col("raw")).alias("keyword"))


@query("item_labels", """SELECT p_partkey, CASE WHEN p_size >= 25 THEN p_brand || ' S' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'E' || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') || ': ' || p_name WHEN p_size >= 10 THEN p_name || ' (' || (1950 + p_size) || ')' ELSE p_name END AS label FROM part""")
def _(t):
    show, year = F.when(F.col("p_size") >= 25, F.col("p_brand")), F.when(F.col("p_size") >= 10, F.col("p_size") + 1950)
    return t("part").select("p_partkey", T.label(F.col("p_name"), year, show, F.col("p_size"), F.col("p_partkey") % 90).alias("label"))


@query("clock", "SELECT p_partkey, (ms // 3600000) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || (ms // 100 % 10) AS clock FROM (SELECT p_partkey, p_partkey * 7919 AS ms FROM part)")
def _(t):
    return t("part").select("p_partkey", T.clock(F.col("p_partkey") * 7919).alias("clock"))


@query("page_hosts", "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY host")
def _(t):
    return t("pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_HOSTS = ("blog.tionsh.example.net", "thther.example.org", "ththhe.example.com", "ththth.example.net", "m.ththth.example.net")


@query("canonical_urls", f"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, CASE WHEN host IN {_HOSTS} AND trim(path, '/') <> '' THEN 'https://' || host || regexp_replace(regexp_replace(path, '/page/\\d+/?$', ''), '/+$', '') END AS url FROM p""")
def _(t):
    return t("pages").select("page_id", T.canonical_list_url(F.col("url"), _HOSTS).alias("url"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<html[^>]*\\blang=\"([^\"]*)\"', 1) AS lang FROM pages")
def _(t):
    return t("pages").select("page_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"))


@query("page_links", """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*\\bhref="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(1, len(h) + 1)) AS place, unnest(h) AS href FROM l""")
def _(t):
    return html.links(t("pages"))


@query("page_text")
def _(t):
    return t("pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("readable_form", "SELECT p_brand, arg_min(p_name, (length(p_name), p_name)) AS name FROM part GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.char_length("p_name"), "p_name")).alias("name"))


@query("derived_facts", "SELECT l_orderkey AS title, l_returnflag AS source, max(l_linenumber) AS rank, epoch_us(max(l_shipdate)) AS fetched_us, bool_or(l_tax > 0.05) AS spoiler FROM lineitem GROUP BY ALL")
def _(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("title"), F.col("l_returnflag").alias("source")).agg(F.max("l_linenumber").alias("rank"), F.unix_micros(F.max("l_shipdate").cast("timestamp")).alias("fetched_us"), F.bool_or(F.col("l_tax") > 0.05).alias("spoiler"))


@query("layered_value", """
WITH v AS (SELECT doc_id, 1 AS layer, CASE WHEN quality = 0 THEN 'low' END AS value FROM labels UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN lang END FROM documents UNION ALL SELECT doc_id, 3, source FROM documents)
SELECT doc_id, arg_min(value, layer) AS value FROM v WHERE value IS NOT NULL GROUP BY doc_id""")
def _(t):
    labels, docs = t("labels"), t("documents")
    person = labels.select("doc_id", F.lit(1).alias("layer"), F.when(F.col("quality") == 0, "low").alias("value"))
    scraper = docs.select("doc_id", F.lit(2).alias("layer"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("value"))
    layers = person.union(scraper).union(docs.select("doc_id", F.lit(3).alias("layer"), F.col("source").alias("value")))
    return layers.where("value IS NOT NULL").groupBy("doc_id").agg(F.min_by("value", "layer").alias("value"))


@query("pending_overlay", """
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'JUMBO' END, p_type) AS p_type, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'JUMBO' END, p_type) IS DISTINCT FROM p_type AS pending FROM part""")
def _(t):
    decided = t("part").where("p_partkey % 4 = 0").select("p_partkey", F.lit("JUMBO").alias("decided"))
    return changes.overlay(t("part").select("p_partkey", "p_type"), decided, ["p_partkey"], "p_type")


@query("spread_picks", "WITH g AS (SELECT p_brand, list_sort(list(p_partkey)) AS k FROM part GROUP BY p_brand) SELECT p_brand, [k[1], k[1 + CAST(round_even((len(k) - 1) / 2e0, 0) AS BIGINT)], k[len(k)]] AS picks FROM g")
def _(t):
    keys = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("k"))
    return keys.select("p_brand", ranking.spread_picks(F.col("k"), 3).alias("picks"))
