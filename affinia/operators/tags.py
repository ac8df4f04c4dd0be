"""Tags of titles: frequencies, lift, co-tags, network edges and nearest titles."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.operators import products
from affinia.operators.packed import counted, gathered, unpack
from affinia.operators.products import best, paired
from affinia.operators.ranking import placed_in_group, top_per_group
from affinia.operators.shared import stored

Z = 2.0
#: Sets of a block in the sums over all pairs, at least; blocks that these grow for, and bytes of a block's packed sets, at most, unless BLOCK sets have more.
BLOCK, BLOCKS, ENTRIES = 4096, 16, 1 << 26
#: Pairs or sums that a task holds at once, numbers of a dense matrix, and cells for each pair below which a tag is summed as one.
CELLS, SLAB, SPARSE = 1 << 22, 1 << 24, 100
#: Tags that travel with a block in one row; a share of cells beyond which all their exact sums are made at once.
TOGETHER, MANY = 4096, 16


def frequencies(tagged: DataFrame) -> DataFrame:
    """tag, df, idf. tagged: title, tag, each pair once."""
    n = tagged.agg(F.count_distinct("title").alias("titles"))
    df = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("tag", "df", (1 + F.log(F.col("titles") / F.col("df"))).alias("idf"))  # one row


def pairs(tagged: DataFrame) -> DataFrame:
    """a, b, shared: how many titles have both, for a < b.

    The titles' tags meet as arrays, so that one shuffle by title and one by pair are enough.
    """
    sets = tagged.groupBy("title").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    a = sets.select(F.posexplode("tags").alias("i", "a"), "tags")
    both = a.select("a", F.explode(F.slice("tags", F.col("i") + 2, F.size("tags"))).alias("b"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "shared").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))


def wilson_low(hits: Column, n: Column, z: float = Z) -> Column:
    """The lower bound of the Wilson interval of hits out of n."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)


def lifted(tagged: DataFrame, top: int = 5) -> DataFrame:
    """tag, other, shared, lift, place: the others that a tag raises most, by the lower bound of the share."""
    df = frequencies(tagged).select("tag", "df")
    n = tagged.agg(F.count_distinct("title").alias("titles"))
    joined = both_ways(pairs(tagged)).join(df.toDF("a", "df_a"), "a").join(df.toDF("b", "df_b"), "b").crossJoin(F.broadcast(n))  # one row
    lift = F.round(wilson_low(F.col("shared"), F.col("df_a")) * F.col("titles") / F.col("df_b"), 6)
    kept = joined.select(F.col("a").alias("tag"), F.col("b").alias("other"), "shared", lift.alias("lift")).where("lift > 1")
    return top_per_group(kept, ["tag"], [F.desc("lift"), F.desc("shared"), F.asc("other")], top)


def co_tags(tagged: DataFrame, anchor: str) -> DataFrame:
    """other, shared, df of the tags on titles that have the anchor: one aggregate counts both."""
    titles = tagged.where(F.col("tag") == anchor).select("title", F.lit(1).alias("__has"))
    counted = tagged.join(titles, "title", "left").where(F.col("tag") != anchor).groupBy("tag").agg(F.count("__has").alias("shared"), F.count(F.lit(1)).alias("df"))
    return counted.where("shared > 0").select(F.col("tag").alias("other"), "shared", "df").orderBy(F.desc("shared"), "other")


def network(tagged: DataFrame, least_df: int = 3, top: int = 6) -> DataFrame:
    """a, b, shared: edges that are in either end's top."""
    common = frequencies(tagged).where(F.col("df") >= least_df).select("tag")
    edges = both_ways(pairs(tagged.join(common, "tag", "left_semi")))
    best = top_per_group(edges, ["a"], [F.desc("shared"), F.asc("b")], top)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared").distinct()


def nearest_titles(tagged: DataFrame, top: int = 12, max_df: int | None = None, per_block: int | None = None) -> DataFrame:
    """title, other, cosine, place by TF-IDF of tags. max_df leaves out tags on more titles, if it is given. Pairs of tagged may repeat.

    Titles with equal tags are one: a set keeps its first titles, as many as an answer can name, and each of its
    titles gets the set's answer. Sets are dealt to blocks of about per_block, and each pair of blocks is a group,
    from which only a set's best leave, so that a hot tag's pairs never cross a shuffle. A set is one row with the
    numbers of its tags, packed (frequent tags have low numbers), copied once for each block; how common a tag is
    travels once for each block that has it. Blocks grow with the sets, so that there are BLOCKS or a few more until
    a block has ENTRIES bytes. There are as many pairs of blocks as cores at least.
    """
    table = stored(tagged, "tagged")
    titles = table.agg(F.count_distinct("title")).first()[0]
    if max_df is not None:
        common = table.distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max_df)
        table = table.join(common, "tag", "left_anti")
    often = table.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("often"))
    numbers = stored(placed_in_group(often, [], [F.desc("often"), F.asc("tag")], "number").select("tag", F.col("number").cast("int").alias("number")), "numbers")
    every = stored(gathered(table.join(numbers, "tag"), "title", "number", "tags"), "every")
    df = stored(counted(every.select(F.lit(0).alias("all"), "tags"), "all", "tags").select("number", F.col("count").alias("df")), "df")
    sets = every.where(F.col("title").isNotNull()).withColumn("same", F.sha2("tags", 256))
    firsts = top_per_group(sets.select("title", "same"), ["same"], [F.asc("title")], top + 1).groupBy("same").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    distinct = stored(firsts.withColumn("title", F.get("titles", F.lit(0))).join(sets.select("title", "tags"), "title"), "distinct")
    count, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("tags") + 64), F.lit(0))).first()
    most = max(BLOCK, ENTRIES * count // max(size, 1))
    per_block = per_block or min(max(BLOCK, -(-count // BLOCKS)), most)
    blocks = max(1, -(-count // per_block), math.isqrt(2 * tagged.sparkSession.sparkContext.defaultParallelism))
    dealt = distinct.select("title", "tags", F.pmod(F.xxhash64("title"), F.lit(blocks)).cast("int").alias("block"))
    inside = counted(dealt, "block", "tags").select("block", "number").join(df, "number")
    known = inside.groupBy(F.col("block").cast("int").alias("block"), F.floor(F.col("number") / TOGETHER)).agg(F.collect_list(F.struct(F.col("number").cast("int").alias("n"), F.col("df").cast("int").alias("df"))).alias("t"))
    parts = blocks * (blocks + 1)

    def near(key: tuple, pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("title", kind="stable", ignore_index=True)
        names, block, packed = pdf.title.to_numpy(), pdf.block.to_numpy(), pdf.tags.to_numpy()
        i, j = key
        number, at = np.unique(np.concatenate([np.zeros(0, np.int64), *of.n]), return_index=True)
        idf = 1 + np.log(titles / np.concatenate([np.zeros(0, np.int64), *of["df"]])[at])
        side = max(1, math.isqrt(CELLS))
        left, right = ([rows[k : k + side] for k in range(0, len(rows), side)] for rows in (np.flatnonzero(block == i), np.flatnonzero(block == j)))
        found: dict[int, tuple] = {}
        ready: dict[int, tuple] = {}

        def weighted(rows: np.ndarray) -> tuple:
            """A tile's tags, unpacked once as long as SLAB of them are held."""
            got = ready.get(rows[0]) or _weighted(packed[rows], number, idf)
            if sum(len(t[0]) for t in ready.values()) + len(got[0]) <= SLAB:
                ready[rows[0]] = got
            return got

        def keep(rows: np.ndarray, others: np.ndarray, c: np.ndarray, slack: float, exact: Callable | None) -> None:
            old = found.get(rows[0])
            bars = None if old is None else _last(old, rows, top)
            new = [(rows[a], others[b], v) for a, b, v in best(lambda lo, hi: c[lo:hi], rows, others, top, 1e-6, bars, slack, exact)]
            found[rows[0]] = _first(new if old is None else [old, *new], top)

        for k, ys in enumerate(right):
            y = weighted(ys)
            for xs in left if i < j else left[: k + 1]:
                c, slack, exact = _products(weighted(xs), y, idf)
                keep(xs, ys, c, slack, exact)
                if xs[0] != ys[0]:
                    keep(ys, xs, c.T if ys[0] in found else np.ascontiguousarray(c.T), slack, exact and (lambda a, b, exact=exact: exact(b, a)))
        one, two, cosine = (np.concatenate(c) for c in zip((np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *found.values(), strict=True))
        return pd.DataFrame({"title": names[one], "other": names[two], "cosine": cosine})

    kind = tagged.schema["title"].dataType.simpleString()
    sent = paired(dealt, blocks).repartition(parts, "i", "j").groupBy("i", "j")
    along = products.paired(known.select("block", F.col("t.n").alias("n"), F.col("t.df").alias("df")), blocks).repartition(parts, "i", "j").groupBy("i", "j")
    scored = sent.cogroup(along).applyInPandas(near, f"title {kind}, other {kind}, cosine double")
    own = distinct.select("title", F.col("title").alias("other"), F.lit(1.0).alias("cosine"))
    others = top_per_group(scored.unionByName(own), ["title"], [F.desc("cosine"), F.asc("other")], top + 1).drop("place")
    each = others.join(distinct.select(F.col("title").alias("other"), "titles"), "other").select("title", F.explode("titles").alias("other"), "cosine")
    lists = top_per_group(each, ["title"], [F.desc("cosine"), F.asc("other")], top + 1).groupBy("title").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "other"))).alias("best"))  # top + 1 at most
    answers = lists.join(distinct.select("title", "same"), "title").select("same", "best")
    rest = F.slice(F.filter("best", lambda x: x["other"] != F.col("title")), 1, top)
    found = sets.select("title", "same").join(answers, "same").select("title", F.posexplode(rest).alias("i", "x"))
    return found.select("title", "x.other", (-F.col("x.minus")).alias("cosine"), (F.col("i") + 1).cast("long").alias("place"))


def _first(held: list, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first top of each row, by cosine and number. held: rows, others, cosines."""
    one, two, cosine = (np.concatenate(c) for c in zip(*held, strict=True))
    by = np.lexsort((two, -cosine, one))
    heads = np.flatnonzero(np.diff(one[by], prepend=-1))
    by = by[np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by)))) < top]
    return one[by], two[by], cosine[by]


def _last(held: tuple, rows: np.ndarray, top: int) -> np.ndarray:
    """The top-th cosine of each of rows, which ascend; 0 for one that has fewer. held: the first top of each."""
    at = np.searchsorted(rows, held[0])
    out = np.full(len(rows), np.inf)
    np.minimum.at(out, at, held[2])
    return np.where(np.bincount(at, minlength=len(rows)) == top, out, 0.0)


def _weighted(packed: np.ndarray, number: np.ndarray, idf: np.ndarray) -> tuple:
    """row, place in number, weight of each tag of packed sets; how many sets have each of number; the norms."""
    tag, sizes = unpack(packed)
    row, at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.searchsorted(number, tag).astype(np.int32)
    w = idf[at]
    norm = np.sqrt(np.bincount(row, w * w))
    return row, at, w / norm[row], np.bincount(at, minlength=len(number)), norm


def _products(x: tuple, y: tuple, idf: np.ndarray) -> tuple[np.ndarray, float, Callable | None]:
    """The sums of products over shared tags, for all rows of x against all of y.

    Tags on many of both are columns of dense matrices, SLAB numbers at a time; the pairs of the others are added one by
    one, CELLS at a time. If one pair of matrices is enough, it is of single precision: then come what a sum can be off
    by, as a share of it (no product is negative), and a function that gives exact sums for rows and columns.
    """
    high, wide = len(x[4]), len(y[4])
    both = x[3] * y[3]
    hot = both * SPARSE >= high * wide
    column, hots = np.cumsum(hot) - 1, int(hot.sum())
    more = _single(x, y, (both > 0) & ~hot) if ((both > 0) & ~hot).any() else None
    step = max(1, SLAB // max(high, wide))
    if hots == 0:
        return (np.zeros((high, wide)) if more is None else more), 0.0, None
    if hots > step:
        c = np.zeros((high, wide)) if more is None else more
        for low in range(0, hots, step):
            a, b = (_dense(side, hot, column, low, min(low + step, hots), np.float64) for side in (x, y))
            c += a @ b.T
        return c, 0.0, None
    a, b = (_dense(side, hot, column, 0, hots, np.float32) for side in (x, y))
    c = a @ b.T
    if more is not None:
        c += more.astype(np.float32)
    in_x, in_y = a > 0, b > 0
    squares, whole = idf[hot] ** 2, []

    def exact(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if len(rows) * MANY > high * wide and not whole:
            whole.append((in_x * squares) @ in_y.T.astype(np.float64))
        if whole:
            sums = whole[0][rows, columns]
        else:
            sums = np.empty(len(rows))
            n = max(1, (CELLS >> 3) // hots)
            for k in range(0, len(rows), n):
                sums[k : k + n] = (in_x[rows[k : k + n]] & in_y[columns[k : k + n]]).astype(np.float64) @ squares
        sums /= x[4][rows] * y[4][columns]
        return sums if more is None else sums + more[rows, columns]

    return c, 2 * (hots + 8) * 2.0**-24, exact


def _single(x: tuple, y: tuple, cold: np.ndarray) -> np.ndarray:
    """The sums over the tags that are cold, pair by pair."""
    high, wide = len(x[4]), len(y[4])
    (l_row, l_at, l_w), (r_row, r_at, r_w) = [[v[cold[side[1]]] for v in side[:3]] for side in (x, y)]
    order = np.argsort(r_at, kind="stable")
    r_row, r_at, r_w = r_row[order], r_at[order], r_w[order]
    first = np.searchsorted(r_at, l_at, "left")
    met = np.searchsorted(r_at, l_at, "right") - first
    ends, done = np.cumsum(met), 0
    c = np.zeros((high, wide))
    while done < len(met):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CELLS, "right")))
        n = met[done:upto]
        mine = np.repeat(np.arange(done, upto), n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[mine]
        c += np.bincount(l_row[mine].astype(np.int64) * wide + r_row[other], l_w[mine] * r_w[other], c.size).reshape(c.shape)
        done = upto
    return c


def _dense(side: tuple, hot: np.ndarray, column: np.ndarray, low: int, high: int, kind: type) -> np.ndarray:
    """The weights of a side's rows on the hot tags of columns low to high."""
    row, at, w = side[:3]
    to = np.where(hot, column, -1)[at] - low
    out = np.zeros((len(side[4]), high - low), kind)
    if high - low < len(hot):
        inside = (to >= 0) & (to < high - low)
        row, to, w = row[inside], to[inside], w[inside]
    out[row, to] = w
    return out


def overrepresented(list_tags: DataFrame, tagged: DataFrame, least_in_list: int = 3, least_lift: float = 3.0, top: int = 20) -> DataFrame:
    """list, tag, in_list, lift, place: tags more common in a list than among all titles. list_tags: list, title."""
    sizes = list_tags.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    n = tagged.agg(F.count_distinct("title").alias("titles"))
    df = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    inside = list_tags.join(tagged, "title").groupBy("list", "tag").agg(F.count(F.lit(1)).alias("in_list")).where(F.col("in_list") >= least_in_list)
    joined = inside.join(sizes, "list").join(df, "tag").crossJoin(F.broadcast(n))  # one row
    lift = F.round(F.col("in_list") / F.col("size") / (F.col("df") / F.col("titles")), 6)
    kept = joined.select("list", "tag", "in_list", lift.alias("lift")).where(F.col("lift") >= least_lift)
    return top_per_group(kept, ["list"], [F.desc("lift"), F.desc("in_list"), F.asc("tag")], top)


def film_suffix_pairs(keywords: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """a, b: each "x film" with "x", but for those to be kept apart. keywords: keyword."""
    bases = keywords.select(F.col("keyword").alias("b"), F.concat("keyword", F.lit(" film")).alias("a"))
    return bases.join(keywords.withColumnRenamed("keyword", "a").where(~F.col("a").isin(keep or [])), "a", "left_semi").select("a", "b")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays; null when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)
