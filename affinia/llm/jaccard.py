"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, and their components.

Two sets link when 100 * |A and B| >= PERCENT * |A or B|. Then they share at least T = ceil(n * PERCENT / 100)
shingles of either set's n (the T-occurrence problem). DivideSkip sets a record's T - 1 longest inverted
lists aside: a partner must be in one of its other, short lists, and the long ones are only probed.

1. Equal sets are one class; the rest works on classes.
2. Across Spark, the short lists of a class are those of its n - T + m rarest shingles, of which partners
   share m. Rarity is the level of a count over all documents, kept in a table of fixed size; any order
   gives all links, a good order keeps the lists short. Pairs of linkable sizes are counted over the
   lists, and those found m times are joined by an edge; lists with very many members are joined by
   ranges of size instead. A neighbourhood is a component of these edges. No link leaves a neighbourhood.
3. The sets of a neighbourhood meet in a task, which merges the short lists with a heap, probes the long
   ones by binary search and keeps partners that reach the overlap that their two sizes need. Pairs that
   are connected already are skipped, which loses no component.
4. A large neighbourhood is cut into blocks of sets of like size, and each set goes to its block only. Then
   one set for each component of a block meets those of the others in the same way. What is left apart is
   compared in full: the sets outside a neighbourhood's largest component visit the blocks whose sizes
   could link with theirs. Near copies in any number thus cross once or twice, not once for each block.
5. Components of the links that were found are components of all links.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing;
its component is its own id. Rows with a null id have the size of their set and no component. Rows
that repeat an id and a text are alike; the same id with different texts is one node, which links what
any of its texts links with. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.common import stored
from affinia.llm.graphs import components
from affinia.llm.hashing import U, mix, shingle_sets

WIDTH, PERCENT = 3, 90
#: Counts are kept for so many hash values, in blocks of this size.
BITS, BLOCK = 22, 1 << 15
#: One more list must be shared for each so many shingles; a list of more members than PAIRS is joined by size.
APART, PAIRS = 25, 64
#: A block has about so many sets and shingles, and a task about as many visitors.
GROUP, GROUP_SHINGLES = 1000, 1_000_000
#: The count of an edge that needs no further lists.
_SURE = 1 << 40


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def needed(n: int, m: int, percent: int) -> int:
    """The overlap at which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def matches(n: int) -> int:
    """How many short lists two sets share if they link; n: the smaller one's size."""
    return 1 + n // APART


def set_ids(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell a set."""
    pair = mix(tokens + U(0x51ED270B)).sum(dtype=U), mix(tokens ^ U(0xD1B54A32D192ED03)).sum(dtype=U)
    return tuple(int(x.astype(np.int64)) for x in pair)


_SIGNED = "doc_id long, n long, h1 long, h2 long, block int, counts binary"


def _sign(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (size and ids of its set) and, from each task, its counts in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        names = [f.split()[0] for f in _SIGNED.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        for batch in batches:
            n, h1, h2, some, held = [], [], [], [], 0
            for tokens in shingle_sets(batch.column(1), width):
                a, b = set_ids(tokens)
                n.append(len(tokens))
                h1.append(a)
                h2.append(b)
                some.append((tokens >> U(64 - BITS)).astype(np.int32))
                held += len(tokens)
                if held > 1 << 21:
                    counts += np.bincount(np.concatenate(some), minlength=1 << BITS)
                    some, held = [], 0
            if held:
                counts += np.bincount(np.concatenate(some), minlength=1 << BITS)
            cols = [batch.column(0), n, h1, h2, [None] * len(n), [None] * len(n)]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if counts.any():
            packed = [zlib.compress(np.minimum(c, 65535).astype(np.uint16).tobytes(), 1) for c in counts.reshape(-1, BLOCK)]
            empty = [None] * len(packed)
            yield pa.record_batch([pa.array(c, k) for c, k in zip([empty, empty, empty, empty, list(range(len(packed))), packed], kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNED)


def _levels(signed: DataFrame) -> np.ndarray:
    """The level (twice the logarithm) of each hash value's count over all documents: 2**BITS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
        made = [(2 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(made, pa.binary())], ["block", "levels"])

    blocks = (1 << BITS) // BLOCK
    rows = signed.where("block IS NOT NULL").select("block", "counts").repartition(16, "block").mapInArrow(run, "block int, levels binary").collect()
    levels = np.zeros((blocks, BLOCK), np.uint8)
    for row in rows:  # a fixed number of blocks
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


def _span(n, percent: int):
    """A range of sizes, numbered: sets that link lie in the same one or in the next. n: a column or an array."""
    width = float(np.log(100 / percent)) * 1.000001  # a little more, so that rounding can't part them further
    return F.floor(F.log(n) / width) if isinstance(n, Column) else np.floor(np.log(n) / width).astype(np.int64)


def _folded(tokens: np.ndarray, of: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """token, h1, n, weight, head of a batch's list entries, with lists of more than PAIRS members made short.

    Such a list is long for the whole corpus too. Of each range of sizes its first and last member stay,
    with the weight of all; the members between are joined to the first by edges (head), outside of the list.
    """
    weight, head = np.ones(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    ordered = np.sort(tokens)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    long_ = ordered[first[np.diff(np.concatenate((first, [len(ordered)]))) > PAIRS]]
    if not len(long_):
        return tokens.view(np.int64), of, n, weight, head
    at = np.minimum(np.searchsorted(long_, tokens), len(long_) - 1)
    mine = np.flatnonzero(long_[at] == tokens)
    span = _span(n[mine], percent)
    order = np.lexsort((of[mine], n[mine], span, tokens[mine]))
    mine, span = mine[order], span[order]
    new = np.concatenate(([True], (tokens[mine][1:] != tokens[mine][:-1]) | (span[1:] != span[:-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(mine)])))
    firsts, lasts = mine[starts], mine[starts + sizes - 1]
    out, owner = tokens.view(np.int64).copy(), of
    head[mine] = np.repeat(of[firsts], sizes)
    weight[mine], weight[lasts] = 0, 1
    weight[firsts] = np.maximum(sizes - 1, 1)
    head[firsts] = head[lasts] = 0
    between = head != 0
    out[between] = owner[between]  # an edge is in no list; it goes to any task
    return out, of, np.where(between, 0, n), weight, head


_LIST = "token long, h1 long, n int, weight long, head long"


def _short_lists(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """token, h1, n, weight, head: each class in the lists of its rarest shingles (once per task); head: see _folded."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, done = sent.value, set()
        for batch in batches:
            found, owners, sizes, counts = [], [], [], []
            for tokens in shingle_sets(batch.column(0), width):
                n = len(tokens)
                # Sets that can only link with equal ones are not in any list.
                if n and needed(n, n + 1, percent) <= n and (h1 := set_ids(tokens)[0]) not in done:
                    done.add(h1)
                    short = min(n, n - least_overlap(n, percent) + matches(n))
                    order = level[(tokens >> U(64 - BITS)).astype(np.int64)].astype(U) << U(56) | tokens >> U(8)
                    found.append(tokens[np.argpartition(order, short - 1)[:short]])
                    owners.append(h1)
                    sizes.append(short)
                    counts.append(n)
            if found:
                of, n = np.repeat(np.array(owners, np.int64), sizes), np.repeat(np.array(counts, np.int64), sizes)
                token, h1, n, weight, head = _folded(np.concatenate(found), of, n, percent)
                yield pa.record_batch([pa.array(token), pa.array(h1), pa.array(n.astype(np.int32)), pa.array(weight), pa.array(head, mask=head == 0)], ["token", "h1", "n", "weight", "head"])

    return docs.where("text IS NOT NULL").select("text").mapInArrow(run, _LIST)


def _neighbours(lists: DataFrame, percent: int) -> DataFrame:
    """u, v: classes that share at least as many short lists as a link would, and chains through long lists.

    A pair that links shares `matches` of the smaller set's size in short lists. If one of these has more
    than PAIRS members, the two are joined through the members between them, whose sizes are closer yet:
    each goes to the first member of its range of sizes, and the first of a range to that of the range
    before it if their members next to each other fit. This joins what a chain from each member to the
    next would, but a component is a few steps deep however long the list is. Otherwise all of these
    lists count the pair.
    """
    by_size = Window.partitionBy("token").orderBy("n", "h1")
    size = F.sum("weight").over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    several = lists.withColumn("size", size).where("size > 1 OR head IS NOT NULL")
    met = F.collect_list(F.when(F.col("size") <= PAIRS, F.struct("h1", "n"))).over(by_size.rowsBetween(-PAIRS, -1))
    ordered = several.withColumn("span", F.when(F.col("n") > 0, _span(F.col("n"), percent)))
    ordered = ordered.withColumn("met", met).withColumn("before", F.lag(F.struct("n", "span")).over(by_size))
    fits = lambda n: n * 100 >= F.col("n") * percent
    opens = F.col("before").isNull() | ~F.col("before.span").eqNullSafe(F.col("span")) | ~fits(F.col("before.n"))
    chain = F.last(F.when(opens, F.col("h1")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    ordered = ordered.withColumn("chain", F.when(F.col("size") > PAIRS, chain))
    edge = lambda u, k, n: F.struct(u.alias("u"), k.cast("long").alias("k"), n.alias("n"))
    sure = lambda u: F.array(edge(u, F.lit(_SURE), F.lit(0)))
    pairs = F.transform(F.filter("met", lambda e: fits(e["n"]) & (e["h1"] != F.col("h1"))), lambda e: edge(e["h1"], F.lit(1), e["n"]))
    edges = F.when(F.col("head").isNotNull(), sure(F.col("head"))).when(F.col("size") > PAIRS, F.when(F.col("chain").isNotNull() & fits(F.col("before.n")), sure(F.col("chain")))).otherwise(pairs)
    counted = ordered.select(F.explode(edges).alias("e"), F.col("h1").alias("v")).groupBy(F.col("e.u").alias("u"), "v").agg(F.sum("e.k").alias("k"), F.min("e.n").alias("n"))
    return counted.where(F.col("k") >= F.floor(F.col("n") / APART) + 1).select("u", "v")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self, xs: list[int]) -> list[int]:
        return [self.root(x) for x in xs]


def divide_skip(sets: list[np.ndarray], percent: int, labels: list[int] | None = None, visits: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets' components. sets: sorted distinct tokens, by size.

    labels: sets with equal ones are connected already; visits: of each pair compared, one is marked here.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    length = np.diff(np.concatenate((first, [len(tokens)])))
    place = np.empty(len(tokens), np.int64)
    place[order] = np.repeat(np.arange(len(first)), length)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    forest, links = Forest(m), []
    known: dict[int, int] = {}
    for r, label in enumerate(labels or []):
        forest.up[r] = known.setdefault(label, r)
    for r in range(1, m):
        n = int(sizes[r])
        most_apart = least_overlap(n, percent)
        low = int(np.searchsorted(sizes, most_apart))
        if low >= r:
            continue
        own = place[starts[r] : starts[r + 1]]
        lists = own[length[own] > 1]
        if len(lists) < most_apart:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")]
        n_short = len(lists) - (most_apart - 1)
        members = lambda k: owner[first[k] : first[k] + length[k]]
        pieces = []
        for k in lists[:n_short].tolist():
            ids = members(k)
            a, b = np.searchsorted(ids, (low, r))
            if b > a:
                pieces.append(ids[a:b].tolist())
        counted = [(s, sum(1 for _ in same)) for s, same in groupby(heapq.merge(*pieces))]
        mine = forest.root(r)
        counted = [(s, c) for s, c in counted if forest.root(s) != mine and (visits is None or visits[s] or visits[r])]
        if not counted:
            continue
        cand = np.array([s for s, _ in counted])
        seen = np.array([c for _, c in counted])
        need = np.array([needed(n, int(sizes[s]), percent) for s in cand])
        long_ = lists[n_short:]
        if len(cand) > len(long_):  # probe each long list for all candidates
            for i, k in enumerate(long_[::-1].tolist()):
                ids = members(k)
                at = np.minimum(np.searchsorted(ids, cand), len(ids) - 1)
                seen = seen + (ids[at] == cand)
                if i % 16 == 15:
                    alive = seen + (len(long_) - i - 1) >= need
                    cand, seen, need = cand[alive], seen[alive], need[alive]
                    if not len(cand):
                        break
            for s in cand[seen >= need].tolist():
                a, b = forest.root(s), forest.root(r)
                if a != b:
                    forest.up[max(a, b)] = min(a, b)
                    links.append((s, r))
        else:  # probe the candidate's tokens for all long lists
            probes = np.sort(tokens[first[long_]])
            for s, c, t in zip(cand.tolist(), seen.tolist(), need.tolist(), strict=True):
                a, b = forest.root(s), forest.root(r)
                if a == b:
                    continue
                other = sets[s]
                at = np.minimum(np.searchsorted(other, probes), len(other) - 1)
                if c + int((other[at] == probes).sum()) >= t:
                    forest.up[max(a, b)] = min(a, b)
                    links.append((s, r))
    return links


_KEY = ["root", "band", "part", "lot"]


def _linked(texts: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: links between the representatives that are placed together.

    placed: root, band, part, lot (the task), doc_id, h1, h2 (the set), label (what is connected already), visits.
    """

    def links(group: dict) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        some = sorted(((len(tokens), node, tokens, label, visits) for node, (tokens, label, visits) in group.items()), key=lambda x: x[:2])
        found = divide_skip([x[2] for x in some], percent, [x[3] for x in some], np.array([x[4] for x in some]))
        return [(some[a][1][0], some[b][1][0]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        made: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            of = zip(*(batch.column(k).to_pylist() for k in range(4, 9)), strict=True)
            for now, (doc_id, h1, h2, label, visits), tokens in zip(keys, of, shingle_sets(batch.column(9), width), strict=True):
                if now != key:
                    made += links(group)
                    key, group = now, {}
                if set_ids(tokens) == (h1, h2):  # else another text under the same id
                    group[doc_id, h1] = tokens, label, visits
        made += links(group)
        yield pa.record_batch([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], ["u", "v"])

    rows = texts.join(placed, "doc_id").repartition(*_KEY).sortWithinPartitions(*_KEY)
    return rows.select(*_KEY, "doc_id", "h1", "h2", "label", "visits", "text").mapInArrow(run, "u long, v long")


def _parts(sets: DataFrame, *by: str) -> DataFrame:
    """How many blocks the sets of each group fill."""
    many = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    return sets.groupBy(*by).agg(many.alias("parts"), F.count(F.lit(1)).alias("size"))


def _node(rep: str = "rep") -> Column:
    return F.xxhash64(rep)  # one to one for a single number, and spread at random


def _blocked(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """sets with band and part, and the parts of each root's bands. A root that fits in one block is one."""
    roots = stored(_parts(sets, "root").where("size > 1").select("root", F.col("parts").alias("blocks")), "roots")
    banded = sets.join(roots, "root").withColumn("band", F.when(F.col("blocks") > 1, _span(F.col("n"), percent)).otherwise(F.lit(0)).cast("long"))
    bands = stored(_parts(banded, "root", "band").select("root", "band", "parts"), "bands")
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    return banded.join(bands, ["root", "band"]).withColumn("part", part).drop("parts"), bands


def _at_home(blocked: DataFrame) -> DataFrame:
    return blocked.select("root", "band", "part", F.lit(0).alias("lot"), F.col("rep").alias("doc_id"), "h1", "h2", _node().alias("label"), F.lit(True).alias("visits"))


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with label, the component of their node by the links so far."""
    groups = components(_hashed(links)).toDF("node", "label")
    return sets.join(groups, _node() == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", _node()))


def _hashed(links: DataFrame) -> DataFrame:
    return links.select(_node("u").alias("u"), _node("v").alias("v"))


def _visiting(blocked: DataFrame, bands: DataFrame) -> DataFrame:
    """Where sets of different components of a root can still meet. blocked: sets with band, part and label."""
    sizes = blocked.groupBy("root", "label").agg(F.count(F.lit(1)).alias("size"))
    apart = sizes.groupBy("root").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count(F.lit(1)).alias("components")).where("components > 1").select("root", "largest")
    left = blocked.join(stored(apart, "apart"), "root")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    guests = left.where("label <> largest").select("root", "rep", "h1", "h2", "n", "label", F.col("band").alias("own_band"), F.col("part").alias("own_part"), near.alias("band"))
    guests = stored(guests.join(bands, ["root", "band"]), "guests")
    lots = stored(_parts(guests, "root", "band").select("root", "band", F.col("parts").alias("lots")), "lots")
    went = guests.join(lots, ["root", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("band <> own_band OR part <> own_part")
    went = went.withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("lots")).cast("int"))
    hosts = left.join(lots, ["root", "band"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    cols = [*_KEY, F.col("rep").alias("doc_id"), "h1", "h2", "label"]
    return went.select(*cols, F.lit(True).alias("visits")).unionByName(hosts.select(*cols, F.lit(False).alias("visits")))


def _links(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: links that connect what is connected. members: n, h1, h2, rep, root."""
    blocked, bands = _blocked(members, percent)
    links = stored(_linked(texts, _at_home(blocked), width, percent), "links")
    large = blocked.where("blocks > 1")
    if large.isEmpty():
        return links
    large = stored(large.drop("blocks"), "large")
    one = F.min_by(F.struct("n", "h1", "h2", "rep"), F.struct("n", "h1")).alias("x")
    heads = _labelled(large, links).groupBy("root", "label").agg(one).select("root", "x.*")
    links = stored(links.unionByName(_linked(texts, _at_home(_blocked(stored(heads, "heads"), percent)[0]), width, percent)), "links")
    visiting = _visiting(stored(_labelled(large, links), "labelled"), bands)
    return links.unionByName(stored(_linked(texts, visiting, width, percent), "last"))


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: representatives of the classes of an id that has several texts."""
    of = F.struct("h1", "h2")
    several = rows.groupBy("doc_id").agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a <> b").select("doc_id")
    reps = rows.join(several, "doc_id", "left_semi").join(classes, ["h1", "h2"]).groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    return reps.select(F.get("reps", F.lit(0)).alias("u"), F.explode("reps").alias("v")).where("u <> v")


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (id_col, text)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    signed = stored(_sign(texts, width), "signed")
    rows = signed.where("block IS NULL").select("doc_id", "n", "h1", "h2")
    lists = _short_lists(texts, _levels(signed), width, percent)
    near = components(_neighbours(lists, percent))

    own = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(own.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    members = stored(classes.join(near, F.col("h1") == F.col("node")).select("n", "h1", "h2", "rep", "root"), "members")
    links = _links(texts, members, width, percent).unionByName(_same_ids(own, classes))

    groups = components(_hashed(links))
    linked = classes.join(groups, _node() == F.col("node")).select("h1", "h2", "rep", "root")
    firsts = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = stored(linked, "linked").join(stored(firsts, "firsts"), "root").select("h1", "h2", "component_id")
    named = classes.select("h1", "h2", "rep").join(linked, ["h1", "h2"], "left")
    named = stored(named.select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id")), "named")
    full = own.join(named, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(alone)
