"""Who is behind a shared account: its plays in clusters by device, address and platform, and how their tastes differ.

plays: account, device, ip, platform, item, unit. All accounts are clustered at once. Devices of an account are one
cluster when an address joins them: one with IP_PLAYS plays or more on devices, under IP_ACCOUNTS accounts at most.
A play without a device goes by its address, if that has IP_PLAYS such plays, else by its platform.

Defined results: a play without any of them is unclustered. An empty device text is a device that is never listed.
Clusters of fewer than FLOOR plays are unattributed: they have no number, no profile and no overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.clusters import components
from affinia.operators.ranking import top_per_group
from affinia.operators.shared import stored

IP_PLAYS, IP_ACCOUNTS, FLOOR, TOP = 2, 1, 20, 20
TIERS = ("client_identifier", "ip", "platform", "unclustered")
CLUSTER = ["account", "tier", "value"]


def join_addresses(plays: DataFrame, ip_plays: int = IP_PLAYS, ip_accounts: int = IP_ACCOUNTS) -> DataFrame:
    """account, ip, reason of each address with two devices or more of an account: why it doesn't join them, null if it does."""
    accounts = plays.where("ip IS NOT NULL").groupBy("ip").agg(F.count_distinct("account").alias("accounts"))
    seen = plays.where("ip IS NOT NULL AND device IS NOT NULL").groupBy("account", "ip").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device").alias("devices"))
    reason = F.when(F.col("n") < ip_plays, "few plays").when(F.col("accounts") > ip_accounts, "many accounts")
    return seen.where("devices > 1").join(accounts, "ip").select("account", "ip", reason.alias("reason"))


def _devices(plays: DataFrame, joining: DataFrame) -> DataFrame:
    """account, device, value: the first device, by name, of those that are joined with a device."""
    node = lambda kind, c: F.to_json(F.array(F.col("account").cast("string"), F.lit(kind), F.col(c)))
    known = plays.where("device IS NOT NULL").select("account", "device").distinct()
    edges = plays.join(joining, ["account", "ip"], "left_semi").where("device IS NOT NULL").select(node("d", "device").alias("a"), node("i", "ip").alias("b")).distinct()
    groups = components(edges).select(F.col("node").alias("__node"), "root")
    placed = known.withColumn("__node", node("d", "device")).join(groups, "__node", "left").withColumn("root", F.coalesce("root", "__node"))
    heads = placed.where("device <> ''").groupBy("root").agg(F.min("device").alias("head"))
    value = F.when(F.col("device") == "", F.col("device")).otherwise(F.col("head"))
    return placed.join(heads, "root", "left").select("account", "device", value.alias("__rep"))


def clustered(plays: DataFrame, ip_plays: int = IP_PLAYS, ip_accounts: int = IP_ACCOUNTS) -> DataFrame:
    """plays with the tier and value of their cluster."""
    joining = join_addresses(plays, ip_plays, ip_accounts).where("reason IS NULL").select("account", "ip")
    devices = stored(_devices(plays, joining), "devices")
    recurring = plays.where("device IS NULL AND ip IS NOT NULL").groupBy("account", "ip").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= ip_plays).select("account", "ip", F.lit(True).alias("__recurs"))
    known = plays.join(devices, ["account", "device"], "left").join(recurring, ["account", "ip"], "left")
    by_ip = F.coalesce("__recurs", F.lit(False))
    tier = F.when(F.col("device").isNotNull(), TIERS[0]).when(by_ip, TIERS[1]).when(F.col("platform").isNotNull(), TIERS[2]).otherwise(TIERS[3])
    value = F.when(F.col("device").isNotNull(), F.col("__rep")).when(by_ip, F.col("ip")).otherwise(F.col("platform"))
    return known.select(*[plays[c] if c not in ("account", "device", "ip") else c for c in plays.columns], tier.alias("tier"), value.alias("value"))


def _listed(column: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col(column) != "", F.col(column))))


def latent_clusters(of: DataFrame, floor: int = FLOOR) -> DataFrame:
    """account, tier, value, number, plays, items, units, devices, ips, platforms of each cluster; of: clustered plays.

    number counts an account's clusters of floor plays or more, devices first, and is null for the others.
    """
    found = of.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("item").alias("items"), F.count_distinct("unit").alias("units"), _listed("device").alias("devices"), _listed("ip").alias("ips"), _listed("platform").alias("platforms"))
    tier = F.array_position(F.array(*[F.lit(x) for x in TIERS]), F.col("tier"))
    order = F.row_number().over(Window.partitionBy("account", F.col("plays") >= floor).orderBy(tier, F.coalesce("value", F.lit(""))))
    return found.withColumn("number", F.when(F.col("plays") >= floor, order))


def unattributed(clusters: DataFrame) -> DataFrame:
    """account, plays, clusters, devices (one at least for each cluster) of the clusters without a number."""
    return clusters.where("number IS NULL").groupBy("account").agg(F.sum("plays").alias("plays"), F.count(F.lit(1)).alias("clusters"), F.sum(F.greatest(F.size("devices"), F.lit(1))).cast("long").alias("devices"))


def profiles(of: DataFrame, clusters: DataFrame, keywords: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """The keywords of each numbered cluster, and how much of it they cover. keywords: unit, keyword.

    The first: account, number, keyword, titles, place: on how many of the cluster's units a keyword is, the most
    frequent first. The second: account, number, units, covered, depth, covered_depth: units, and plays, with any keyword.
    """
    known = keywords.select("unit", "keyword").distinct()
    value = F.coalesce("value", F.lit("")).alias("value")
    numbered = clusters.where("number IS NOT NULL").select("account", "tier", value, "number")
    units = stored(of.select("account", "tier", value, "unit").join(numbered, CLUSTER).groupBy("account", "number", "unit").agg(F.count(F.lit(1)).alias("depth")), "units")
    counts = units.join(known, "unit").groupBy("account", "number", "keyword").agg(F.count(F.lit(1)).alias("titles"))
    best = top_per_group(counts, ["account", "number"], [F.desc("titles"), F.asc("keyword")], top)
    covers = units.join(known.select("unit").distinct().withColumn("has", F.lit(True)), "unit", "left")
    coverage = covers.groupBy("account", "number").agg(F.count(F.lit(1)).alias("units"), F.count("has").alias("covered"), F.sum("depth").alias("depth"), F.sum(F.when(F.col("has"), F.col("depth")).otherwise(0)).alias("covered_depth"))
    return best, coverage


def overlaps(best: DataFrame) -> DataFrame:
    """account, a, b, overlap: Jaccard of the first keywords of two clusters of an account; pairs that share none have no row."""
    one = stored(best.select("account", "number", "keyword"), "keywords")
    sizes = one.groupBy("account", "number").agg(F.count(F.lit(1)).alias("n"))
    other = one.withColumnRenamed("number", "b")
    shared = one.withColumnRenamed("number", "a").join(other, ["account", "keyword"]).where("a < b").groupBy("account", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(sizes.select("account", F.col("number").alias("a"), F.col("n").alias("na")), ["account", "a"]).join(sizes.select("account", F.col("number").alias("b"), F.col("n").alias("nb")), ["account", "b"])
    return sized.select("account", "a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap"))
