"""The typed calls on a small store."""

from __future__ import annotations

import math

import pytest

from affinia.plans.api import Api, as_json
from affinia.schemas import TABLES
from affinia.sources.store import Store


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('api')}/s")

    def rows(name, *values):
        schema = TABLES[name].schema
        return spark.createDataFrame([tuple(v.get(f.name) for f in schema) for v in values], schema)

    movies = [{"item_id": i, "type": "movie", "title": i.title(), "library": "m"} for i in ("alpha", "beta", "gamma")]
    shows = [{"item_id": i, "type": "show", "title": i} for i in ("finished", "abandoned", "loose")]
    episodes = [{"item_id": f"f{s}{e}", "type": "episode", "show_item_id": "finished", "season": s, "episode": e} for s in (1, 2) for e in range(5)]
    episodes += [{"item_id": f"a{e}", "type": "episode", "show_item_id": "abandoned", "season": 1, "episode": e} for e in range(10)]
    facts = [("alpha", "heist", "tmdb"), ("alpha", "heist", "list"), ("alpha", "ensemble cast", "tmdb"), ("beta", "heist", "tmdb"), ("gamma", "space", "tmdb"), ("finished", "sitcom", "tmdb"), ("finished", "workplace", "tmdb"), ("abandoned", "bailed", "tmdb")]
    plays = ["alpha", "alpha", "beta", *(f"f1{e}" for e in range(5)), "a0", "a1"]
    store.publish(
        {
            "items": rows("items", *movies, *shows, *episodes),
            "enrichment": rows("enrichment", *({"item_id": i, "namespace": "n", "source": s, "key": "keyword", "value": v} for i, v, s in facts)),
            "plays": rows("plays", *({"history_key": f"{k:03}", "item_id": i, "account_id": 42, "viewed_at": k, "ip": "1.1.1.1"} for k, i in enumerate(plays)), {"history_key": "900", "item_id": "beta", "account_id": 7, "viewed_at": 50}),
            "edges": rows("edges", {"from_id": "alpha", "to_id": "gamma", "edge_type": "similar", "rank": 2}, {"from_id": "alpha", "to_id": "beta", "edge_type": "similar", "rank": 1}, {"from_id": "beta", "to_id": "alpha", "edge_type": "recommendations", "rank": 1}),
            "keyword_forms": rows("keyword_forms", {"surface": "bank heist", "keyword": "bank heist"}, {"surface": "Bank-Heist", "keyword": "bank heist"}, {"surface": "heist", "keyword": "heist"}),
            "keyword_pairs": rows("keyword_pairs", {"a": "bank heist", "b": "heist", "score": 0.95}, {"a": "heist", "b": "space", "score": 0.1, "decision": "rejected"}),
            "frames": rows("frames", *({"item_id": i, "t_ms": 0, "shot": 0, "vector": v, "model": "m1"} for i, v in (("alpha", [127, 0, 0]), ("beta", [127, 127, 0])))),
        }
    )
    return Api(store)


def test_items(api):
    assert [r.item_id for r in api.items(type="movie", limit=1).collect()] == ["alpha", "beta"]
    assert [r.item_id for r in api.items(type="movie", after="alpha").collect()] == ["beta", "gamma"]
    full = {r.item_id: r for r in api.items(type="movie", include=["enrichment", "external_ids"]).collect()}
    assert [f.value for f in full["alpha"].enrichment] == ["ensemble cast", "heist"] and full["alpha"].external_ids == []
    assert api.exists("alpha") and not api.exists("delta")
    with pytest.raises(ValueError):
        api.items(limit=5000)


def test_taste_and_watched(api):
    got = {r.value: r.weight for r in api.taste(42).collect()}
    assert got["heist"] == pytest.approx(1 + math.sqrt(2) / 2) and got["sitcom"] == pytest.approx(0.5) and "bailed" not in got
    assert {r.value: r.weight for r in api.taste().collect()}["heist"] == pytest.approx(math.sqrt(2) / 2 + math.sqrt(2))
    assert [r.unit for r in api.watched(42).collect()] == ["alpha", "beta", "finished"]


def test_edges_and_plays(api):
    assert [r.item_id for r in api.edges("alpha", "similar").collect()] == ["beta", "gamma"]
    assert [r.item_id for r in api.edges("alpha", direction="to").collect()] == ["beta"]
    page = api.plays(account=42, since=3, limit=3)
    assert [r.history_key for r in page.collect()] == ["003", "004", "005", "006"] and "ip" not in page.columns
    assert {(r.account_id, r.plays) for r in api.accounts().collect()} == {(42, 10), (7, 1)}


def test_keywords(api):
    assert api.keyword("bank heist").first().readable == "Bank-Heist"
    assert [r.keyword for r in api.keywords(surface="Bank-Heist").collect()] == ["bank heist"]
    assert [r.other for r in api.pairs("heist", "undecided").collect()] == ["bank heist"]
    assert {(r.member, r.representative) for r in api.merges().collect()} == {("heist", "heist"), ("bank heist", "heist")}
    assert [(r.other, r.shared, r.df) for r in api.neighbours("heist", "movie").collect()] == [("ensemble cast", 1, 1)]


def test_search(api):
    got = [(r["item"], r.score) for r in api.search([1.0, 0.0, 0.0]).collect()]
    assert got[0] == ("alpha", 1.0) and got[1] == ("beta", pytest.approx(0.707107))
    assert [r["item"] for r in api.search([1.0, 0.0, 0.0], pool=["beta", "beta"]).collect()] == ["beta"]
    assert api.search([1.0, 0.0, 0.0], temperature=0.5, draw=1, seed=4).count() == 1
    assert as_json(api.item("alpha")).first().value.startswith('{"item_id":"alpha"')
