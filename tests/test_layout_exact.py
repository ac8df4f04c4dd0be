"""The map's layout, exact sums and draws, and a store's versions, against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.operators import exact, layout
from affinia.plans.registry import QUERIES
from affinia.schemas import TABLES
from affinia.sources.store import Store

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mixed(state):
    z = state
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & MASK
    return z ^ (z >> 31)


def bits_of(seed, column):
    state, out = seed ^ (column * 0x9E3779B97F4A7C15 & MASK), []
    for _ in range(4):
        state = (state + 0x9E3779B97F4A7C15) & MASK
        out.append(mixed(state))
    return out


def test_signs():
    columns = np.array([0, 1, 2, 77, 1 << 40])
    for seed in (0, 1, MASK):
        assert layout.sign_words(columns, seed).tolist() == [bits_of(seed, int(c)) for c in columns]
    signs = layout.signs(np.arange(400), 1)
    assert set(np.unique(signs)) == {-1.0, 1.0} and abs(signs.mean()) < 0.02
    assert signs[3].tolist() == [1.0 if bits_of(1, 3)[k // 64] >> k % 64 & 1 else -1.0 for k in range(256)]


@pytest.mark.parametrize("dims", [256, 64])
def test_vectors(spark, dims):
    rnd = random.Random(dims)
    cells = [(f"t{i}", c, rnd.random() + 0.1) for i in range(40) for c in sorted(rnd.sample(range(100), rnd.randint(1, 30)))]
    got = layout.vectors(spark.createDataFrame(cells, "item string, column long, value double").repartition(5), 100, 3, dims).collect()
    want = defaultdict(lambda: np.zeros(min(100, dims), np.float32))
    norms = defaultdict(list)
    for i, _, v in cells:
        norms[i].append(v)
    for i, c, v in cells:
        add = np.float32(v / np.sqrt(np.sum(np.square(norms[i]))))
        if dims >= 100:
            want[i][c] += add
        else:
            want[i] += add * np.array([1.0 if bits_of(3, c)[k // 64] >> k % 64 & 1 else -1.0 for k in range(dims)], np.float32)
    assert {r["item"]: tuple(r.vector) for r in got} == {i: tuple(float(x) for x in v) for i, v in want.items()}


def groups(n=160, kinds=4):
    """Titles of a few kinds: tags of their own kind, and some of any."""
    rnd = random.Random(5)
    rows = set()
    for i in range(n):
        rows |= {(f"t{i:03}", f"k{i % kinds}-{rnd.randint(0, 11)}") for _ in range(6)} | {(f"t{i:03}", f"any-{rnd.randint(0, 9)}")}
    return sorted(rows)


def near_of(rows, top=8):
    tags = defaultdict(set)
    for i, t in rows:
        tags[i].add(t)
    out = []
    for a, x in tags.items():
        best = sorted(((-len(x & y) / (len(x) * len(y)) ** 0.5, b) for b, y in tags.items() if b != a))[:top]
        out += [(a, b, -s) for s, b in best if s < 0]
    return out


def kept_neighbours(points, near):
    """The share of the nearest titles that are among the 24 nearest points."""
    names = sorted(points)
    at = np.array([points[i] for i in names])
    apart = np.linalg.norm(at[:, None] - at[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    close = {names[i]: {names[j] for j in np.argsort(apart[i])[:24]} for i in range(len(names))}
    return sum(b in close[a] for a, b, _ in near) / len(near)


def test_a_map_keeps_neighbours(spark):
    rows = groups()
    near = near_of(rows)
    table, graph = spark.createDataFrame(rows, "item string, tag string"), spark.createDataFrame(near, "item string, other string, weight double")
    got = {}
    for rounds, graph_ in ((0, None), (6, graph)):
        points = {r["item"]: (r.x, r.y) for r in layout.title_map(table, graph_, rounds=rounds, dims=64).collect()}
        assert len(points) == 160
        xs, ys = zip(*points.values(), strict=True)
        assert min(xs) == min(ys) == 0 and max(*xs, *ys) == 1
        got[rounds] = kept_neighbours(points, near)
    assert got[6] > got[0] and got[6] > 0.6  # a random map keeps 24 of 159
    again = {r["item"]: (r.x, r.y) for r in layout.title_map(table.repartition(7), graph.repartition(3), rounds=6, dims=64).collect()}
    assert max(abs(a - b) for i in points for a, b in zip(points[i], again[i], strict=True)) <= 2e-5


def test_small_maps(spark):
    few = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x"), ("c", "y"), ("d", "z"), ("a", None)], "item string, tag string")
    assert [tuple(r) for r in layout.title_map(few).orderBy("item").collect()] == [("a", 0.0, 0.5), ("b", 0.5, 0.5), ("c", 1.0, 0.5)]
    assert layout.title_map(few.limit(0)).count() == 0
    assert layout.title_map(few, exclude=["x"]).count() == 0


def pairwise(a):
    """The rule for one row, in 32 bits, by recursion."""
    n = len(a)
    if n < 8:
        s = np.float32(0)
        for x in a:
            s = np.float32(s + x)
        return s
    if n <= 128:
        r = list(a[:8])
        for i in range(8, n - n % 8):
            r[i % 8] = np.float32(r[i % 8] + a[i])
        f = np.float32
        s = f(f(f(r[0] + r[1]) + f(r[2] + r[3])) + f(f(r[4] + r[5]) + f(r[6] + r[7])))
        for x in a[n - n % 8 :]:
            s = f(s + x)
        return s
    half = n // 2 - n // 2 % 8
    return np.float32(pairwise(a[:half]) + pairwise(a[half:]))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 127, 128, 129, 300, 1000])
def test_pairwise_sums(n):
    rows = np.random.default_rng(n).normal(size=(9, n)).astype(np.float32) * 1000
    assert [float(x) for x in exact.pairwise_sums(rows)] == [float(pairwise(r)) for r in rows]


def test_pairwise_norm(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=w)]) for i, w in enumerate((64, 64, 3, 0, 200))] + [(9, None)]
    got = {r.id: r.n for r in spark.createDataFrame(rows, "id long, v array<float>").select("id", exact.pairwise_norm("v").alias("n")).collect()}
    for i, v in rows:
        a = None if v is None else np.array(v, np.float32)
        assert got[i] == (None if v is None else float(np.sqrt(pairwise(a * a))))


def test_tree_sums_are_the_same_bits_for_any_partitioning(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("aaab"), i, rnd.choice([None, rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 9)])) for i in range(40000)] + [("c", -1, None)]
    table = spark.createDataFrame(rows, "g string, id long, v double")
    sums = [{r.g: r.total for r in exact.tree_sums(table.repartition(n, *by), ["g"], [F.col("id")], "v").collect()} for n, by in ((1, []), (7, []), (3, ["id"]))]
    assert sums[0] == sums[1] == sums[2] and set(sums[0]) == {"a", "b"}

    def folded(v):
        while len(v) > 1:
            parts = []
            for k in range(0, len(v), 128):
                s = 0.0
                for x in v[k : k + 128]:
                    s += x
                parts.append(s)
            v = parts
        return v[0] + 0.0

    assert sums[0] == {g: folded([v for h, _, v in rows if h == g and v is not None]) for g in "ab"}
    assert exact.tree_sums(table.where("g = 'c'"), ["g"], [F.col("id")], "v").count() == 0


class Mix:
    def __init__(self, seed):
        self.state = seed

    def unit(self):
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        return (mixed(self.state) >> 11) / (1 << 53)


def drawn_by_hand(p, n, seed):
    if any(x is None for x in p):
        return list(range(min(n, len(p))))
    w, rng, out = [float(np.float32(x)) for x in p], Mix(seed), []
    for _ in range(min(n, len(p))):
        total = 0.0
        for x in w:
            total += x
        if total > 0:
            target, acc, chosen = rng.unit() * total, 0.0, 0
            for i, x in enumerate(w):
                if x > 0:
                    acc, chosen = acc + x, i
                    if acc > target:
                        break
        else:
            chosen = next(i for i in range(len(p)) if i not in out)
        w[chosen] = 0.0
        out.append(chosen)
    return out


@pytest.mark.parametrize("kind", ["many", "zeros", "null", "few", "none", "blocks"])
def test_sequential_draw(spark, monkeypatch, kind):
    rnd = random.Random(kind)
    p = {"many": [rnd.random() ** 6 for _ in range(300)], "zeros": [0.0, 0.5, 0.0, 1e-30, 0.0, 0.0], "null": [0.1, None, 0.3], "few": [0.2, 0.8], "none": [], "blocks": [rnd.random() for _ in range(200)]}[kind]
    if kind == "blocks":
        monkeypatch.setattr(exact, "DRAWN", 16)
    table = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id long, probability double").repartition(3)
    for seed in (1, 7, MASK):
        got = exact.sequential_draw(table, 5, seed, [F.asc("id")]).orderBy("pick").collect()
        assert [r.id for r in got] == drawn_by_hand(p, 5, seed)


def test_draw_of_the_tables(spark):
    from affinia.operators import vectors
    from affinia.plans.catalogue import _AXES, _frames

    scored = vectors.softmax(vectors.shot_scores(_frames(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")), _AXES[0]), 0.1).collect()
    rows = sorted(scored, key=lambda r: (-r.score, r["item"], r.shot))
    want = [(rows[k]["item"], rows[k].shot) for k in drawn_by_hand([r.probability for r in rows], 10, 7)]
    assert [(r["item"], r.shot) for r in QUERIES["sequential_draw"](spark, SF).orderBy("pick").collect()] == want


def test_title_map_of_the_tables(spark):
    points = QUERIES["title_map"](spark, SF).collect()
    assert len({r["item"] for r in points}) == len(points) > 0
    assert min(r.x for r in points) == 0 and max(max(r.x, r.y) for r in points) == 1


def test_a_store_swaps_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    item = lambda *ids: spark.createDataFrame([(i, "movie", i, i, 1, None, None, None, None, "l") for i in ids], TABLES["items"].schema)
    edge = lambda *ids: spark.createDataFrame([(i, "x", "similar", 1) for i in ids], TABLES["edges"].schema)
    assert store.publish_changed({"items": item("a", "b"), "edges": edge("a")}) == (1, ["edges", "items"])
    assert store.publish_changed({"items": item("b", "a"), "edges": edge("a")}) == (1, [])
    assert store.publish_changed({"items": item("a", "b"), "edges": edge("b")}) == (2, ["edges"])
    assert sorted(r.item_id for r in store.table("items").collect()) == ["a", "b"] and store.table("edges", 1).first().from_id == "a"
    with pytest.raises(ValueError, match="from 2 to 1"):
        store.publish_changed({"items": item("a"), "edges": edge("c")})
    assert store.versions() == [1, 2] and store.table("edges").first().from_id == "b"
    assert store.rollback(1) == 3 and store.table("edges").first().from_id == "a" and store.damaged() == []
    # Null and value in another column, and repeated rows, are other digests.
    from affinia.sources.store import digest

    frame = lambda *rows: spark.createDataFrame(list(rows), "a long, b long")
    assert len({tuple(digest(frame(*r)).values()) for r in ([(None, 1)], [(1, None)], [(1, 1)], [(1, 1), (1, 1)], [(None, 1), (None, 1)])}) == 5
    for f in (tmp_path / "s/v1/edges").glob("*.parquet"):
        f.unlink()
    assert store.damaged(1) == ["edges"] and store.damaged(2) == []
