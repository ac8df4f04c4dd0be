"""Steps that depend on how large a table is, at sizes made small for the test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from affinia.operators import matching, tags, vectors
from affinia.plans.registry import QUERIES
from affinia.sources import pages

SF = "/root/testdata/sf0.001"


def test_recursion_beyond_the_row_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        found = {r.part: (r.steps, r.total) for r in QUERIES["recursive_reach"](spark, SF).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(found) == spark.read.parquet(f"{SF}/part.parquet").count()
    for part, got in found.items():
        way = [part]
        while way[-1] > 0:
            way.append(way[-1] // 2)
        assert got == (len(way) - 1, sum(way))


def test_lists_of_many_pages(spark):
    page = "<head><meta name=description content='A list of {n} films'><body class=list-page><h1 class=title-1>x</h1><li data-item-slug=f{k} data-item-name=F>{link}"
    rows = []
    for name, n, last in (("long", 150, None), ("lost", 130, "/gone"), ("round", 9, "/round/4"), ("short", 8, None)):
        for k in range(n):
            to = f"/{name}/{k + 1}" if k < n - 1 else last
            rows.append((f"/{name}/{k}", page.format(n=n + (name == "short"), k=k, link=f"<a class=next href={to}>" if to else "")))
    lists = spark.createDataFrame([(x, f"/{x}/0") for x in ("long", "lost", "round", "short", "none")], "list string, path string")
    table = spark.createDataFrame(rows, "path string, html string")
    assert sorted((r.list, r.page) for r in pages.followed(lists, table).collect()) == sorted((x, k + 1) for x, n in (("long", 150), ("lost", 130), ("round", 9), ("short", 8)) for k in range(n))
    none = spark.createDataFrame([], "slug string, html string"), spark.createDataFrame([], "kind string, tmdb_id string, item_id string")
    outcomes = {r.list: (r.entries, r.outcome) for r in pages.harvested(lists, table, *none)[1].collect()}
    assert outcomes == {"long": (150, "too_long"), "lost": (130, "broken"), "round": (9, "broken"), "short": (8, "short"), "none": (0, "missing")}


def test_chamfer_in_pieces(spark):
    rng = np.random.default_rng(3)
    frames = [(int(k % 4), int(k // 8), [float(x) for x in rng.normal(size=5)]) for k in range(80)]
    frames += [(1, 99, [0.0] * 5), (2, 98, None), (3, 97, [1.0, 2.0]), (0, 96, [1.0, None, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(frames, "item long, t_ms long, vector array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 9), (0, 1)], "a long, b long")

    def cosine(u, v):
        if u is None or v is None or len(u) != len(v) or None in u or None in v or not any(u) or not any(v):
            return 0.0
        return float(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)))

    def mean(a, b):
        best = {}
        for x in (f for f in frames if f[0] == a):
            s = max(cosine(x[2], y[2]) for y in frames if y[0] == b)
            best[x[1]] = max(best.get(x[1], -2), s)
        return sum(best.values()) / len(best)

    want = {(a, b): round(min(mean(a, b), mean(b, a)), 6) for a, b in ((0, 1), (0, 2), (1, 3))}
    for sizes in ((7, 1), (32, 1000)):
        got = {(r.a, r.b): r.score for r in vectors.chamfer(table, pairs, *sizes).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert vectors.chamfer(table.limit(0), pairs).count() == 0


def test_no_row_for_each_pair_of_frames(spark):
    """The products are made in tasks: only a frame's best of each piece leaves them."""
    rows = [(k % 3, k, [float(k % 7 + 1), float(k % 5)]) for k in range(300)]
    frames = spark.createDataFrame(rows, "item long, t_ms long, vector array<double>")
    plan = vectors.chamfer(frames, spark.createDataFrame([(0, 1)], "a long, b long"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "zip_with" not in plan


def test_greedy_stretches_share_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 30)), int(rng.integers(0, 40_000)), int(k % 2)) for k in range(600)]
    free = {(u, t, k) for k, u, t, side in rows if side}
    want = set()
    for k, u, t, side in rows:
        near = [(abs(x[1] - t), x[1], x[2], x) for x in free if x[0] == u and abs(x[1] - t) <= 900]
        if not side and near:
            delta, _, other, taken = min(near)
            free.remove(taken)
            want.add((k, other, delta))
    left = spark.createDataFrame([(k, u, t) for k, u, t, side in rows if not side], "left_id long, u long, t long")
    right = spark.createDataFrame([(k, u, t) for k, u, t, side in rows if side], "right_id long, u long, t long")
    for per_group in (1, 100, 10_000):
        assert {tuple(r) for r in matching.greedy_matches(left, right, ["u"], per_group=per_group).collect()} == want
    assert matching.greedy_matches(left.limit(0), right, ["u"]).count() == 0


def test_pages_of_a_small_file_are_read_by_all_tasks(spark):
    one = spark.range(100).coalesce(1).selectExpr("id", "'<p>' AS html", "'1' AS tmdb_id")
    for read in (pages.read_lists, pages.read_films, pages.read_themes):
        assert read(one, "id").rdd.getNumPartitions() >= 4


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(120, 4))
    v[60:90] = v[:30]  # equal cosines rank by id
    table = spark.createDataFrame([(int(k), [float(x) for x in row]) for k, row in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    want = {k: [m for _, m in sorted((-cos[k, m], m) for m in range(120) if m != k and cos[k, m] >= 0.6)][:5] for k in range(120)}
    for per_block in (200, 17):
        got = {k: [] for k in range(120)}
        for r in vectors.nearest_vectors(table, 5, 0.6, per_block).orderBy("id", "place").collect():
            got[r.id].append(r.other)
        assert got == want


def test_blocks_grow_with_the_rows(spark):
    """Rows beyond 16 blocks' worth are in larger blocks, so that a row's copies stay as many."""
    table = spark.range(40_000).select("id", F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("vector"))
    plan = vectors.nearest_vectors(table, 1, 0.99)._jdf.queryExecution().optimizedPlan().toString()
    assert ", 42), 16)" in plan


def test_nearest_titles_send_a_row_for_each_set(spark, monkeypatch):
    """Titles of equal tags are one row of the blocks, whatever their tags; dense and single sums together, against all pairs."""
    monkeypatch.setattr(tags, "CELLS", 700)
    monkeypatch.setattr(tags, "SLAB", 60)
    monkeypatch.setattr(tags, "SPARSE", 12)
    sent, real = [], tags.paired
    monkeypatch.setattr(tags, "paired", lambda rows, blocks: sent.append((rows.count(), blocks)) or real(rows, blocks))
    rng = np.random.default_rng(11)
    sets = [sorted({"all", *(f"hot{k}" for k in rng.integers(0, 6, 3)), *(f"rare{k}" for k in rng.integers(0, 40, 2))}) for _ in range(60)]
    have = {k: sets[k % 60 if k < 90 else 0] for k in range(120)}  # some twice, one of 32 titles
    names = sorted({t for some in sets for t in some})
    x = np.array([[t in some for t in names] for some in have.values()], float)
    x *= 1 + np.log(len(have) / x.sum(axis=0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(x @ x.T, 6)
    want = {(a, b, -c, k + 1) for a in have for k, (c, b) in enumerate(sorted((-cos[a, b], b) for b in have if b != a and cos[a, b] > 0)[:4])}
    tagged = spark.createDataFrame([(a, t) for a, some in have.items() for t in some], "title long, tag string")
    for per_block in (None, 17):
        assert {tuple(r) for r in tags.nearest_titles(tagged, top=4, per_block=per_block).collect()} == want
    assert {n for n, _ in sent} == {len({tuple(some) for some in sets})}


def test_harvests_join_by_shuffles(spark):
    """Sides that grow with the input are small on disk, but must not pass the driver."""
    lists = spark.createDataFrame([("a", "/a")], "list string, path string")
    page = spark.createDataFrame([("/a", "<body class=list-page><h1 class=title-1>x</h1><li data-item-slug=f data-item-name=F>")], "path string, html string")
    films = spark.createDataFrame([("f", '<body data-type="film" data-tmdb-id="7">')], "slug string, html string")
    known = spark.createDataFrame([("movie", "7", "i7")], "kind string, tmdb_id string, item_id string")
    entries, outcomes = pages.harvested(lists, page, films, known)
    for found in (pages.followed(lists, page), entries):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in entries.collect()] == [("a", 1, "tmdb", "7", "i7")]
    assert [tuple(r) for r in outcomes.collect()] == [("a", "x", 1, "harvested")]


def test_known_bars_are_not_looked_for_again(monkeypatch):
    from affinia.operators import products

    c = np.round(np.random.default_rng(2).normal(size=(40, 90)), 1)
    ids, others = np.arange(100, 140), np.arange(90)
    run = lambda **more: [x.tolist() for x in next(products.best(lambda low, high: c[low:high].copy(), ids, others, 5, 0.1, **more))]
    want = run()
    monkeypatch.setattr(products.np, "partition", None)
    assert run(bars=np.sort(c, axis=1)[:, -9]) == want


def test_packed_sets(spark, monkeypatch):
    """Gaps of each width and maps of bits come back as they were; pieces of a set, repeats and a null key are merged."""
    from affinia.operators import packed

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, most, n)) for most, n in ((40, 30), (1600, 600), (1 << 31, 5), (1 << 20, 3), (1, 1), (129, 1), (300, 290)) for _ in range(9)]
    order = rng.permutation(len(sets))
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    numbers, back = packed.unpack(packed.pack(np.concatenate(sets), np.cumsum(sizes) - sizes))
    assert (numbers == np.concatenate(sets)).all() and (back == sizes).all()
    assert [len(x) for x in packed.unpack([])] == [0, 0] and packed.pack(numbers[:0], numbers[:0]) == []
    monkeypatch.setattr(packed, "ROWS", 50)
    pairs = [(None if k == 7 else f"k{k}", int(n)) for k, some in enumerate(sets) for n in some[some < 1 << 20]]
    table = spark.createDataFrame([*pairs, *pairs[::3]], "key string, n int").repartition(3)
    made = packed.gathered(table, "key", "n", "set")
    have = {r.key: packed.unpack([bytes(r.set)])[0].tolist() for r in made.collect()}
    assert have == {key: sorted(n for k, n in pairs if k == key) for key in {k for k, _ in pairs}}
    counted = {(r.number, r["count"]) for r in packed.counted(made.select(F.lit(0).alias("all"), "set"), "all", "set").collect()}
    assert counted == {(n, sum(n == m for _, m in pairs)) for n in {n for _, n in pairs}}


def test_nearest_titles_send_packed_sets(spark, monkeypatch):
    """A set of half of all tags is a few bits for each tag in every copy; repeated pairs count once."""
    sent, real = [], tags.paired
    monkeypatch.setattr(tags, "paired", lambda rows, blocks: sent.append(rows.collect()) or real(rows, blocks))
    rng = np.random.default_rng(13)
    x = rng.random((60, 300)) < 0.5
    pairs = [(k, f"tag{n}") for k, n in np.argwhere(x).tolist()]
    w = x * (1 + np.log(60 / x.sum(axis=0)))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cos = np.round(w @ w.T, 6)
    want = {(a, b, float(-c), k + 1) for a in range(60) for k, (c, b) in enumerate(sorted((-cos[a, b], b) for b in range(60) if b != a)[:5])}
    tagged = spark.createDataFrame([*pairs, *pairs[::2]], "title long, tag string")
    assert {tuple(r) for r in tags.nearest_titles(tagged, top=5, per_block=25).collect()} == want
    size = lambda v: len(v) if isinstance(v, (bytes, bytearray)) else 4 * len(v) if isinstance(v, list) else 8
    assert sum(size(v) for row in sent[0] for v in row) <= 60 * (300 / 8 + 24)


def test_products_of_single_precision_give_exact_answers():
    """Near products with a slack give the same best as plain ones in double precision, few or many of them exact."""
    from affinia.operators import packed, products

    rng = np.random.default_rng(17)
    x = rng.random((80, 120)) < np.where(np.arange(120) < 90, 0.4, 0.02)
    row, number = np.nonzero(x)
    sets = np.array(packed.pack(number, np.searchsorted(row, np.arange(80))), dtype=object)
    idf = 1 + np.log(80 / np.maximum(x.sum(axis=0), 1))
    w = x * idf / np.linalg.norm(x * idf, axis=1, keepdims=True)
    a, b = (tags._weighted(some, np.arange(120), idf) for some in (sets[:30], sets[30:]))
    c, slack, exact = tags._products(a, b, idf)
    assert c.dtype == np.float32 and 0 < slack < 1e-4
    for top in (2, 50):
        run = lambda m, **more: [v.tolist() for v in next(products.best(lambda low, high: m[low:high].copy(), np.arange(30), np.arange(30, 80), top, 1e-6, **more))]
        assert run(c, slack=slack, exact=exact) == run(w[:30] @ w[30:].T)
