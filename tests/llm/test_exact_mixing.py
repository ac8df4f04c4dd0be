from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinia.llm.exact_dedup import exact_dedup
from affinia.llm.mixing import measured, mix, rates, targets


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, some in groups.items():
        keep = min(some, key=lambda x: (-len(x[1]), x[0]))[0]
        out += [(i, keep, len(some), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in some]
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né ", max_size=4)), max_size=30))
def test_same_as_brute_force(docs_of, texts):
    rows = list(enumerate(texts))
    assert sorted(map(tuple, exact_dedup(docs_of(rows)).collect())) == brute(rows)


def test_ties_nulls_repeats(docs_of):
    rows = [(5, "a b"), (2, "ab "), (9, "a  b"), (7, "a  b"), (None, "ab"), (3, None), (4, "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs_of(rows)).collect()}
    assert got == {(5, 7, 5, False), (2, 7, 5, False), (9, 7, 5, False), (7, 7, 5, True), (None, 7, 5, False), (3, 3, 2, True), (4, 3, 2, False)}


def test_long_texts_and_a_hot_group(docs_of):
    long_ = "word " * 50_000
    rows = [(i, long_) for i in range(20)] + [(100, long_ + "x")] + [(200 + i, "same") for i in range(300)]
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs_of(rows)).collect()}
    assert got[19] == 0 and got[100] == 100 and got[499] == 200


def test_empty_tables(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    assert rates(measured(docs_of([]))).count() == 0
    assert mix(docs_of([])).count() == 0


def spread(sizes, weights):
    """Water-filling as the contract words it."""
    pool, free, target = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        share = {i: pool * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > 2 * sizes[i]}
        if not above:
            for i in free:
                target[i] = share[i]
            break
        for i in above:
            target[i] = 2.0 * sizes[i]
            pool -= target[i]
        free -= above
    return target


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9))
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = spread(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix(docs_of):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(900)] + [(None, None, "en", None)]
    docs = docs_of(rows)
    sized = rates(measured(docs)).collect()
    taken, target = defaultdict(int), {}
    for r in sized:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.1 * t for s, t in target.items() if t)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    n = defaultdict(int)
    for r in mixed.collect():
        n[r.doc_id] += 1
    assert {r.doc_id: r.copies for r in sized if r.copies} == dict(n)


def test_stored_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    from affinia.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    kept = common.bucketed(spark.range(100).withColumnRenamed("id", "row"), "rows", "row", 3)
    assert kept.count() == common.stored(spark.range(100), "range").count() == 100
    assert kept.join(kept.withColumnRenamed("row", "other"), kept["row"] == F.col("other")).count() == 100
    common.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))
