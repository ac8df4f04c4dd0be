"""Close vectors by cells, against all pairs in one matrix, and how many blocks rows visit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinia.operators import cells

SCHEMA = "id long, vector array<float>, other string"


def plain(ids, vectors, top, least):
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(x @ x.T, 6)
    out = set()
    for i, me in enumerate(ids):
        near = sorted((-cos[i, j], o) for j, o in enumerate(ids) if o != me and cos[i, j] >= least)[:top]
        out |= {(int(me), int(o), -c, k + 1) for k, (c, o) in enumerate(near)}
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "vector": [v.tolist() for v in vectors], "other": "x"}), SCHEMA)


def mixed(n, seed):
    """Clusters, near copies, exact copies and random vectors; ids in no order."""
    r = np.random.default_rng(seed)
    heads = r.normal(size=(6, 16))
    v = np.concatenate((heads[r.integers(0, 6, n)] + 0.2 * r.normal(size=(n, 16)), r.normal(size=(n // 2, 16)))).astype(np.float32)
    v = np.concatenate((v, np.repeat(v[:1], n // 2, axis=0), v[5:25] * 2))
    return r.permutation(len(v)) * 3, v


@pytest.mark.parametrize("least", [0.3, 0.9])
def test_equals_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(cells, "BLOCK", 32)
    monkeypatch.setattr(cells, "LOT", 50)
    ids, v = mixed(240, 3)
    found = {tuple(r) for r in cells.close_vectors(frame(spark, ids, v), 5, least).collect()}
    assert found == plain(ids, v, 5, least)


def test_odd_rows_and_repeats(spark):
    good = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "b"), (2, [2.0, 0.0], "b"), (3, [0.0, 1.0], "c")]
    odd = [(4, None, "d"), (5, [], "e"), (6, [0.0, 0.0], "f"), (7, [None, 1.0], "g"), (8, [float("nan"), 1.0], "h"), (9, [float("inf"), 1.0], "i"), (None, [1.0, 0.0], "j")]
    found = cells.close_vectors(spark.createDataFrame(good + odd, SCHEMA), 3, 0.5).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    empty = cells.close_vectors(spark.createDataFrame(odd, SCHEMA), 3, 0.5)
    assert empty.columns == ["id", "other", "cosine", "place"] and empty.isEmpty()
    with pytest.raises(ValueError, match="above 0"):
        cells.close_vectors(empty.select("id", F.array(F.lit(1.0)).alias("vector")), 3, 0.0)


def test_visits_of_clustered_rows_do_not_grow(spark, monkeypatch):
    """Twice the clusters and rows: as many blocks a row, where all pairs in blocks would take twice as many."""
    monkeypatch.setattr(cells, "BLOCK", 40)
    counted = []
    real = cells.visits

    def counting(placed, rings, bars, centroids):
        out = real(placed, rings, bars, centroids)
        counted.append((out.count() / placed.count(), placed.select("cell", "ring", "sub").distinct().count()))
        return out

    monkeypatch.setattr(cells, "visits", counting)
    for clusters in (20, 40):
        r = np.random.default_rng(1)
        heads = r.normal(size=(clusters, 32))
        v = (heads[np.arange(clusters * 40) % clusters] + 0.1 * r.normal(size=(clusters * 40, 32))).astype(np.float32)
        cells.close_vectors(frame(spark, np.arange(len(v)), v), 5, 0.9).count()
    (few, blocks), (more, twice) = counted
    assert twice > 1.5 * blocks and more < 1.3 * few + 0.5 and more < twice / 4


@pytest.mark.parametrize("copies", [2, 100])
def test_rows_of_random_vectors_are_copied_a_bounded_number_of_times(spark, monkeypatch, copies):
    """Where no bound holds off much, blocks are joined to areas; the answer stays that of all pairs."""
    for name, value in (("BLOCK", 32), ("LOT", 50), ("COPIES", copies)):
        monkeypatch.setattr(cells, name, value, raising=False)
    counted, real = {}, cells.stored

    def storing(df, name="table"):
        out = real(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(cells, "stored", storing)
    v = np.random.default_rng(4).normal(size=(400, 24)).astype(np.float32)
    v[300:340] = v[7]
    ids = np.arange(400)
    found = {tuple(r) for r in cells.close_vectors(frame(spark, ids, v), 5, 0.1).collect()}
    assert found == plain(ids, v, 5, 0.1)
    if copies == 2:
        assert counted["visits"] <= (copies + 1) * counted["distinct"]
