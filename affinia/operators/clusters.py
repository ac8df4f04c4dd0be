"""Connected components, merge maps of judged pairs, and device clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.shared import stored

ACCEPT = 0.9


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that a node is linked with. edges: a, b.

    Labels go to the least neighbour's, and then to that label's own label, until nothing changes; only
    a row count reaches the driver in each round.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        after = stored(met.join(jump, "low").select("node", F.col("root").alias("was"), F.least("low", "beyond").alias("root")))
        labels = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return labels


def accepted_pairs(pairs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """a, b: pairs that a person accepted, and undecided ones that score high enough. pairs: a, b, score, decision."""
    yes = (F.col("decision") == "accepted") | (F.col("decision").isNull() & (F.col("score") >= accept))
    return pairs.where(F.coalesce(yes, F.lit(False))).select("a", "b")


def merge_map(pairs: DataFrame, titles: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """member, representative of each merged group: no film suffix first, most titles, then the name. titles: keyword, titles."""
    groups = components(accepted_pairs(pairs, accept))
    sized = groups.join(titles, groups["node"] == titles["keyword"], "left").select("node", "root", F.coalesce("titles", F.lit(0)).alias("titles"))
    order = F.struct(F.endswith("node", F.lit(" film")), (-F.col("titles")).alias("t"), "node")
    heads = sized.groupBy("root").agg(F.min_by("node", order).alias("representative"))
    return groups.join(heads, "root").select(F.col("node").alias("member"), "representative")


def folded(values: DataFrame, merges: DataFrame, column: str = "keyword") -> DataFrame:
    """values with the column's members replaced by their representatives, each row once."""
    joined = values.join(merges, values[column] == merges["member"], "left")
    return joined.select(*[F.coalesce("representative", column).alias(column) if c == column else values[c] for c in values.columns]).distinct()


def similar_pairs(words: DataFrame, least: float) -> DataFrame:
    """a, b, score of distinct words whose edit distance leaves at least so much of the longer one. words: keyword.

    An edit changes two of a word's letter pairs (with its edges, length + 1 of them), so words of such a
    score share all but 2 * distance of them; each word looks among its 2 * distance + 1 rarest for partners.
    least has to be above one half, as below it nothing needs to be shared.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least is above 0.5, and 1 at most")
    sized = words.select("keyword", F.char_length("keyword").alias("n")).where("n > 0").distinct()
    framed = F.concat(F.lit("\u0002"), "keyword", F.lit("\u0003"))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.substring(framed, i, F.lit(2)))
    grams = sized.select("keyword", "n", F.explode(pairs).alias("gram"))
    each = grams.groupBy("keyword", "n", "gram").agg(F.count(F.lit(1)).alias("times"))
    numbered = each.select("keyword", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda k: F.concat("gram", k.cast("string")))).alias("gram"))
    df = numbered.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # The longer word has up to n / least letters, and the distance up to that times 1 - least.
    most = F.floor(F.col("n") / F.lit(least) * F.lit(1 - least) + 1e-9).cast("int")
    rarest = F.row_number().over(Window.partitionBy("keyword").orderBy("df", "gram"))
    short = numbered.join(df, "gram").withColumn("place", rarest).where(F.col("place") <= 2 * most + 1).select("gram", "keyword", "n")
    other = short.select("gram", F.col("keyword").alias("b"), F.col("n").alias("m"))
    near = (F.col("keyword") < F.col("b")) & (F.least("n", "m") + 1e-9 >= F.greatest("n", "m") * F.lit(least))
    met = short.join(other, "gram").where(near).select(F.col("keyword").alias("a"), "b").distinct()
    score = 1 - F.levenshtein("a", "b") / F.greatest(F.char_length("a"), F.char_length("b"))
    return met.withColumn("score", score).where(F.col("score") + 1e-9 >= least)


def near_duplicate_fold(pairs: DataFrame, items: DataFrame, least: float = 0.97) -> DataFrame:
    """item, kept: which item stands for each that is folded. pairs: a, b, score; items: item, organized, since.

    Pairs of such a score are one group, chains included; an organized item stays, else the earliest, else
    the least by id.
    """
    groups = components(pairs.where(F.col("score") >= least).select("a", "b"))
    order = F.struct(~F.coalesce("organized", F.lit(False)), F.col("since").isNull(), "since", "item")
    known = groups.join(items, groups["node"] == items["item"])
    heads = known.groupBy("root").agg(F.min_by("item", order).alias("kept"))
    return known.join(heads, "root").where("item <> kept").select("item", "kept")


def decision_bucket():
    """accepted or 0.9 and more: merged; rejected: rejected; 0.5 and more: proposed."""
    return F.when(F.col("decision") == "accepted", "merged").when(F.col("decision") == "rejected", "rejected").when(F.col("score") >= ACCEPT, "merged").when(F.col("score") >= 0.5, "proposed")


def device_clusters(plays: DataFrame, ip_plays: int = 2, ip_accounts: int = 1, floor: int = 20) -> DataFrame:
    """device, cluster, tier: devices joined by an address that is seen often enough by few accounts.

    plays: account, device, ip, and perhaps platform. Clusters of fewer plays than floor are put together
    by platform, and those that are still too small, or have none, are unclustered.
    """
    good = plays.where("ip IS NOT NULL").groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account").alias("accounts")).where((F.col("n") >= ip_plays) & (F.col("accounts") <= ip_accounts))
    seen = plays.join(good, "ip", "left_semi").select(F.concat(F.lit("d:"), "device").alias("a"), F.concat(F.lit("i:"), "ip").alias("b")).distinct()
    groups = components(seen).where(F.startswith("node", F.lit("d:"))).select(F.substr("node", F.lit(3)).alias("device"), F.col("root").alias("cluster"))
    counts = plays.groupBy("device").agg(F.count(F.lit(1)).alias("plays"))
    named = counts.join(groups, "device", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("d:"), "device")))
    sizes = named.groupBy("cluster").agg(F.sum("plays").alias("total"), F.count(F.lit(1)).alias("devices"))
    small = F.col("total") < floor
    tier = F.when(small, "unclustered").when(F.col("devices") > 1, "ip").otherwise("device")
    placed = named.join(sizes, "cluster").select("device", "cluster", "plays", tier.alias("tier"))
    if "platform" not in plays.columns:
        return placed
    of = plays.where("platform IS NOT NULL").groupBy("device").agg(F.min("platform").alias("platform"))
    rest = placed.join(of, "device", "left").withColumn("platform", F.when(F.col("tier") == "unclustered", F.col("platform")))
    totals = rest.where("platform IS NOT NULL").groupBy("platform").agg(F.sum("plays").alias("of_platform")).where(F.col("of_platform") >= floor)
    known = rest.join(totals, "platform", "left").withColumn("in", F.col("of_platform").isNotNull())
    cluster = F.when(F.col("in"), F.concat(F.lit("p:"), "platform")).otherwise(F.col("cluster"))
    return known.select("device", cluster.alias("cluster"), "plays", F.when(F.col("in"), "platform").otherwise(F.col("tier")).alias("tier"))
