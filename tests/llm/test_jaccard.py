from __future__ import annotations

import random
import re

import numpy as np
import pytest

import affinia.llm.jaccard as J
from affinia.llm.graphs import components
from affinia.llm.jaccard import divide_skip, join_components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups=12, size=9):
    rnd = random.Random(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(rnd.choice((5, 9, 11, 14, 60, 150)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
                words[rnd.randrange(len(words))] = rnd.choice(("X", "y", "Zz"))
            rows.append((at, rnd.choice((" ", "\n", "  ")).join(words)))
            at += 1
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 70)])
def test_same_as_brute_force(docs_of, seed, width, percent):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (906, "ＯＮＥ two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(docs_of(rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_large_neighbourhoods_are_cut(docs_of, monkeypatch):
    rows = corpus(5, groups=2, size=40)
    monkeypatch.setattr(J, "GROUP", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(docs_of(rows), 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_blocks_that_only_visits_connect(docs_of, monkeypatch):
    """Chains of growing texts: neighbourhoods whose components meet across blocks and sizes."""
    monkeypatch.setattr(J, "GROUP", 4)
    monkeypatch.setattr(J, "PAIRS", 3)
    rnd = random.Random(11)
    rows = []
    for c in range(3):
        base = [f"c{c}w{k}" for k in range(200)]
        for k in range(30):
            cut = 60 + rnd.choice((3, 9)) * k // 3
            words = base[:cut]
            for _ in range(rnd.choice((0, 0, 1, 2))):
                words[rnd.randrange(len(words))] = "x"
            rows.append((len(rows), " ".join(words)))
    for width, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(docs_of(rows), width, percent).collect()}
        assert got == brute(rows, width, percent)


def test_an_id_with_several_texts_is_one_node(docs_of):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (9, "c d e"), (9, "f g h"), (11, "f g h")]
    got = sorted((r.doc_id, r.component_id) for r in join_components(docs_of(rows)).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (9, 9), (11, 9)]


def test_folded_lists_keep_what_they_join():
    rnd = np.random.default_rng(3)
    tokens = rnd.choice(np.array([5, 6, 7], np.uint64), 500, p=[0.8, 0.15, 0.05])
    of, n = np.arange(1, 501), rnd.integers(10, 200, 500)
    token, h1, size, weight, head = J._folded(tokens, of, n, 90)
    for t in (5, 6):
        inside = (token == t) & (head == 0)
        assert weight[inside].sum() == (tokens == t).sum()
        assert set(J._span(n[tokens == t], 90)) == set(J._span(size[inside], 90))
    assert ((token == 7) & (head == 0)).sum() == (tokens == 7).sum()
    joined = head != 0
    assert all(J._span(n[h - 1 : h], 90) == J._span(n[i - 1 : i], 90) for i, h in zip(h1[joined], head[joined], strict=True))


def test_long_lists_are_joined_by_size(docs_of, monkeypatch):
    monkeypatch.setattr(J, "PAIRS", 2)
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[: rnd.randint(20, 120)] + ["end"] * rnd.randint(0, 3))) for k in range(60)]
    rows += [(100 + k, text) for k, text in corpus(6, groups=3, size=12)]
    for width, percent in ((3, 90), (2, 70)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(docs_of(rows), width, percent).collect()}
        assert got == brute(rows, width, percent)


def test_repeats_nulls_and_nothing(docs_of):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b  c d")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join_components(docs_of(rows)).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert join_components(docs_of([])).count() == 0


def test_divide_skip_finds_the_components():
    rnd = random.Random(4)
    for _ in range(20):
        base = rnd.sample(range(400), 60)
        sets = []
        for _ in range(25):
            s = set(base)
            for x in rnd.sample(base, rnd.choice((0, 1, 3, 6))):
                s.remove(x)
                s.add(rnd.randrange(400, 500))
            sets.append(np.array(sorted(s), np.uint64))
        sets.sort(key=len)
        links = divide_skip(sets, 90)
        up = list(range(len(sets)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                same = len(np.intersect1d(sets[a], sets[b]))
                if 100 * same >= 90 * (len(sets[a]) + len(sets[b]) - same):
                    up[root(a)] = root(b)
        want = [root(i) for i in range(len(sets))]
        up[:] = range(len(sets))
        for a, b in links:
            same = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * same >= 90 * (len(sets[a]) + len(sets[b]) - same)
            up[root(b)] = root(a)
        got = [root(i) for i in range(len(sets))]
        assert [[x == y for y in want] for x in want] == [[x == y for y in got] for x in got]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(40)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edges, "a long, b long").select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    roots = {r.node: r.root for r in components(df).collect()}
    groups = len(set(roots.values()))
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    alone = {n for e in edges for n in e if e[0] == e[1]} - {n for e in edges if e[0] != e[1] for n in e}
    assert groups == len({root(n) for n in up if n not in alone})
