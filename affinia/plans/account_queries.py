"""Queries of the report on shared accounts: events are plays, their users the devices of 23 accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinia.operators import latent
from affinia.plans.catalogue import query

_PLAYS = """p AS (SELECT user_id % 23 AS account, CASE WHEN event_id % 6 > 0 THEN 'd' || user_id END AS device,
    CASE event_id % 4 WHEN 0 THEN 'home' || (user_id % 23) || '-' || (user_id % 7) WHEN 1 THEN 'cafe' || (event_id % 5) WHEN 2 THEN 'once' || (event_id // 3) END AS ip,
    CASE WHEN event_id % 10 > 1 THEN event_type END AS platform, 'i' || (event_id % 300) AS item, 'u' || (event_id % 50) AS unit FROM events)"""


def _plays(t):
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in parts])
    ip = F.when(e % 4 == 0, text("home", u % 23, "-", u % 7)).when(e % 4 == 1, text("cafe", e % 5)).when(e % 4 == 2, text("once", F.floor(e / 3)))
    return t("events").select((u % 23).alias("account"), F.when(e % 6 > 0, text("d", u)).alias("device"), ip.alias("ip"), F.when(e % 10 > 1, F.col("event_type")).alias("platform"), text("i", e % 300).alias("item"), text("u", e % 50).alias("unit"))


def _keywords(t):
    """A unit's keywords: brands of parts, but for a fifth of the units."""
    k = F.col("p_partkey") % 50
    return t("part").where(k % 5 != 0).select(F.concat(F.lit("u"), k.cast("string")).alias("unit"), F.concat("p_brand", F.lit("/"), "p_type").alias("keyword")).distinct()


_CLUSTERS = f"""WITH RECURSIVE {_PLAYS},
    w AS (SELECT ip, count(DISTINCT account) AS accounts FROM p WHERE ip IS NOT NULL GROUP BY ip),
    s AS (SELECT account, ip, count(*) AS n, count(DISTINCT device) AS devices FROM p WHERE ip IS NOT NULL AND device IS NOT NULL GROUP BY ALL),
    j AS (SELECT account, ip, CASE WHEN n < 2 THEN 'few plays' WHEN accounts > 1 THEN 'many accounts' END AS reason FROM s JOIN w USING (ip) WHERE devices > 1),
    e AS (SELECT DISTINCT account, device, ip FROM p JOIN j USING (account, ip) WHERE reason IS NULL AND device IS NOT NULL),
    r AS (SELECT DISTINCT account, device, device AS other FROM p WHERE device IS NOT NULL UNION SELECT r.account, r.device, y.device FROM r JOIN e x ON x.account = r.account AND x.device = r.other JOIN e y ON y.account = x.account AND y.ip = x.ip),
    m AS (SELECT account, device, min(other) AS rep FROM r GROUP BY ALL),
    g AS (SELECT account, ip, true AS recurs FROM p WHERE device IS NULL AND ip IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
    c AS (SELECT p.*, CASE WHEN device IS NOT NULL THEN 'client_identifier' WHEN recurs THEN 'ip' WHEN platform IS NOT NULL THEN 'platform' ELSE 'unclustered' END AS tier,
                 CASE WHEN device IS NOT NULL THEN rep WHEN recurs THEN ip ELSE platform END AS value FROM p LEFT JOIN m USING (account, device) LEFT JOIN g USING (account, ip)),
    k AS (SELECT account, tier, value, count(*) AS plays, count(DISTINCT item) AS items, count(DISTINCT unit) AS units, list_sort(list(DISTINCT device) FILTER (device IS NOT NULL)) AS devices, list_sort(list(DISTINCT ip) FILTER (ip IS NOT NULL)) AS ips FROM c GROUP BY ALL),
    n AS (SELECT *, CASE WHEN plays >= 20 THEN row_number() OVER (PARTITION BY account, plays >= 20 ORDER BY list_position(['client_identifier', 'ip', 'platform', 'unclustered'], tier), coalesce(value, '')) END AS number FROM k),
    h AS (SELECT DISTINCT 'u' || (p_partkey % 50) AS unit, p_brand || '/' || p_type AS keyword FROM part WHERE p_partkey % 50 % 5 <> 0),
    d AS (SELECT c.account, n.number, c.unit, count(*) AS depth FROM c JOIN n ON n.account = c.account AND n.tier = c.tier AND n.value IS NOT DISTINCT FROM c.value WHERE n.number IS NOT NULL GROUP BY ALL),
    b AS (SELECT account, number, keyword, count(*) AS titles FROM d JOIN h USING (unit) GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY account, number ORDER BY titles DESC, keyword) AS place FROM b QUALIFY place <= 20)"""


def _clusters(t):
    of = latent.clustered(_plays(t))
    return of, latent.latent_clusters(of)


@query("latent_clusters", f"{_CLUSTERS} SELECT account, tier, value, CAST(number AS INTEGER) AS number, plays, items, units, len(coalesce(devices, [])) AS devices, array_to_string(coalesce(ips, []), ',') AS ips FROM n")
def _(t):
    return _clusters(t)[1].select("account", "tier", "value", "number", "plays", "items", "units", F.size("devices").cast("long").alias("devices"), F.array_join("ips", ",").alias("ips"))


@query("join_addresses", f"{_CLUSTERS} SELECT account, ip, reason FROM j")
def _(t):
    return latent.join_addresses(_plays(t))


@query("latent_unattributed", f"{_CLUSTERS} SELECT account, CAST(sum(plays) AS BIGINT) AS plays, count(*) AS clusters, CAST(sum(greatest(len(coalesce(devices, [])), 1)) AS BIGINT) AS devices FROM n WHERE number IS NULL GROUP BY account")
def _(t):
    return latent.unattributed(_clusters(t)[1])


@query("latent_profiles", f"{_CLUSTERS} SELECT account, CAST(number AS INTEGER) AS number, keyword, titles, place FROM t")
def _(t):
    of, clusters = _clusters(t)
    return latent.profiles(of, clusters, _keywords(t))[0]


@query("latent_coverage", f"{_CLUSTERS} SELECT account, CAST(number AS INTEGER) AS number, count(*) AS units, count(*) FILTER (unit IN (SELECT unit FROM h)) AS covered, CAST(sum(depth) AS BIGINT) AS depth, CAST(coalesce(sum(depth) FILTER (unit IN (SELECT unit FROM h)), 0) AS BIGINT) AS covered_depth FROM d GROUP BY ALL")
def _(t):
    of, clusters = _clusters(t)
    return latent.profiles(of, clusters, _keywords(t))[1]


@query("latent_overlaps", f"""{_CLUSTERS}, z AS (SELECT account, number, count(*) AS n FROM t GROUP BY ALL), o AS (SELECT x.account, x.number AS a, y.number AS b, count(*) AS shared FROM t x JOIN t y ON x.account = y.account AND x.keyword = y.keyword AND x.number < y.number GROUP BY ALL)
SELECT o.account, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(shared * 1e0 / (x.n + y.n - shared), 6) AS overlap FROM o JOIN z x ON x.account = o.account AND x.number = a JOIN z y ON y.account = o.account AND y.number = b""")
def _(t):
    of, clusters = _clusters(t)
    best = latent.profiles(of, clusters, _keywords(t))[0]
    return latent.overlaps(best).withColumn("overlap", F.round("overlap", 6))
