"""Hand-computed cases of the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from affinia.operators import changes, clusters, matching, ranking, tags, taste, timeline, vectors


@pytest.fixture(scope="module")
def house(spark):
    """Three films and three shows: one watched whole, one left early, one without seasons."""
    plays = [(42, "Alpha")] * 2 + [(42, "Beta")] + [(42, "Finished")] * 5 + [(42, "Abandoned")] * 2 + [(42, "No Seasons")] * 2
    episodes = [("Finished", s, f"f{s}{e}") for s in (1, 2) for e in range(5)] + [("Abandoned", 1, f"a{e}") for e in range(10)] + [("No Seasons", None, f"n{e}") for e in range(4)]
    attributes = [("Alpha", "heist"), ("Alpha", "ensemble cast"), ("Beta", "heist"), ("Gamma", "space"), ("Finished", "sitcom"), ("Finished", "workplace"), ("Abandoned", "bailed"), ("No Seasons", "seasonless")]
    return (
        spark.createDataFrame(plays, "account long, unit string"),
        spark.createDataFrame(episodes, "unit string, season int, episode string"),
        spark.createDataFrame([(u, "tmdb", "keyword", v) for u, v in attributes], "unit string, namespace string, key string, value string"),
    )


def test_taste(house):
    got = {r.value: r.weight for r in taste.taste(*house).collect()}
    assert got["heist"] == pytest.approx(1 + math.sqrt(2) / 2)
    assert got["sitcom"] == got["workplace"] == pytest.approx(0.5)
    assert "bailed" not in got
    assert got["seasonless"] == pytest.approx(math.sqrt(2))


def test_pooled_taste(spark, house):
    plays = house[0].union(spark.createDataFrame([(7, "Beta")], "account long, unit string"))
    got = {r.value: r.weight for r in taste.pooled_taste(plays, *house[1:]).collect()}
    assert got["heist"] == pytest.approx(math.sqrt(2) / 2 + math.sqrt(2))


def test_nine_seasons(spark):
    episodes = spark.createDataFrame([("s", s, f"{s}-{e}") for s in range(9) for e in range(5)], "unit string, season int, episode string")
    plays = spark.createDataFrame([(1, "s")] * 45, "account long, unit string")
    attributes = spark.createDataFrame([("s", "n", "k", "v")], "unit string, namespace string, key string, value string")
    assert taste.taste(plays, episodes, attributes).first().weight == pytest.approx(3.0)


def test_shows_without_seasons(house):
    assert [r.unit for r in taste.shows_without_seasons(house[1]).collect()] == ["No Seasons"]


def test_pairs_and_co_tags(spark):
    tagged = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a")], "title long, tag string")
    assert {(r.a, r.b): r.shared for r in tags.pairs(tagged).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert [(r.other, r.shared, r.df) for r in tags.co_tags(tagged, "a").collect()] == [("b", 2, 2), ("c", 1, 1)]


def test_jaccard_of_nothing_is_null(spark):
    row = spark.range(1).select(tags.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j")).first()
    assert row.j is None


def test_search(spark):
    def hot(k):
        return [1.0 if i == k else 0.0 for i in range(3)]

    frames = spark.createDataFrame([("a", 0, 0, hot(0)), ("a", 1, 10_000, [1.0, 1.0, 0.0]), ("b", 0, 0, hot(0)), ("d", 0, 0, hot(1))], "item string, shot int, t_ms long, vector array<double>")
    plain = {(r["item"], r.shot): r.score for r in vectors.shot_scores(frames, hot(0), digits=4).collect()}
    assert plain == {("a", 0): 1.0, ("a", 1): 0.7071, ("b", 0): 1.0, ("d", 0): 0.0}
    less = {(r["item"], r.shot): r.score for r in vectors.shot_scores(frames, hot(0), [hot(1), hot(2)], 0.5, 4).collect()}
    assert less[("a", 1)] == pytest.approx(0.7071 - 0.3536, abs=2e-4)


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "score double")
    rows = [r.probability for r in vectors.softmax(df, 0.5).orderBy(F.desc("score")).collect()]
    assert sum(rows) == pytest.approx(1) and rows == sorted(rows, reverse=True)


def test_draw_repeats_and_follows_scores(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, score double")
    one, two = ([r.id for r in vectors.draw(df, 5, 3, 1.0, ["id"]).collect()] for _ in range(2))
    assert one == two and len(set(one)) == 5
    assert {r.id for r in vectors.draw(df, 5, 3, 1e-6, ["id"]).collect()} == {15, 16, 17, 18, 19}


def test_shots(spark):
    df = spark.createDataFrame([("x", [400, 600, 900, 1200, 9000], 5000)], "item string, cuts array<long>, duration_ms long")
    got = [(r.start_ms, r.end_ms) for r in timeline.shots(df).orderBy("shot").collect()]
    assert got == [(0, 600), (600, 1200), (1200, 5000)]
    assert [r.t_ms for r in timeline.samples(timeline.shots(df)).orderBy("t_ms").collect()] == [300, 900, 2200, 4200]


def test_peaks_keep_their_distance(spark):
    df = spark.createDataFrame([("x", t * 1000, s) for t, s in ((0, 0.9), (100, 0.8), (121, 0.7), (300, 0.95))], "item string, t_ms long, score double")
    assert [(r.t_ms, r.place) for r in vectors.peaks(df).orderBy("place").collect()] == [(300_000, 1), (0, 2), (121_000, 3)]


def test_greedy_claims_once(spark):
    left = spark.createDataFrame([(1, "k", 100), (2, "k", 110)], "left_id long, key string, t long")
    right = spark.createDataFrame([(7, "k", 105), (8, "k", 500)], "right_id long, key string, t long")
    near = {(r.left_id, r.right_id) for r in matching.nearest_in_time(left, right, ["key"]).collect()}
    assert near == {(1, 7), (2, 7)}
    greedy = {(r.left_id, r.right_id) for r in matching.greedy_matches(left, right, ["key"]).collect()}
    assert greedy == {(1, 7), (2, 8)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in clusters.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_merge_map_prefers_no_film_suffix(spark):
    pairs = spark.createDataFrame([("spy", "spy film", 1.0, None), ("war", "war film", 0.95, "rejected"), ("noir", "film noir", 0.2, "accepted")], "a string, b string, score double, decision string")
    titles = spark.createDataFrame([("spy", 3), ("spy film", 90), ("noir", 1), ("film noir", 5)], "keyword string, titles long")
    merges = clusters.merge_map(pairs, titles)
    assert {(r.member, r.representative) for r in merges.collect()} == {("spy", "spy"), ("spy film", "spy"), ("noir", "film noir"), ("film noir", "film noir")}
    values = spark.createDataFrame([("t", "spy"), ("t", "spy film"), ("t", "war")], "title string, keyword string")
    assert sorted(r.keyword for r in clusters.folded(values, merges).collect()) == ["spy", "war"]


def test_upsert_and_slices(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, changes.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, changes.upserted(old, new, ["k"], update=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_file_changes(spark):
    ddl = "path string, size long, mtime long, hash string"
    known = spark.createDataFrame([("/same", 1, 1, "a"), ("/touched", 1, 1, "b"), ("/old", 1, 1, "c"), ("/gone", 1, 1, "d"), ("/changed", 1, 1, "e")], ddl)
    listed = spark.createDataFrame([("/same", 1, 1, None), ("/touched", 1, 2, "b"), ("/moved", 1, 1, "c"), ("/copy", 1, 1, "a"), ("/new", 1, 1, "z"), ("/changed", 2, 2, "y")], ddl)
    got = {r.path: r.change for r in changes.file_changes(listed, known).collect()}
    assert got == {"/same": "same", "/touched": "touched", "/moved": "moved", "/copy": "copy", "/new": "new", "/changed": "changed", "/gone": "missing", "/old": "missing"}


def test_pages(spark):
    df = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a long, b long")
    assert [tuple(r) for r in ranking.page(df, ["a", "b"], [0, 1], 3).collect()] == [(0, 2), (1, 0), (1, 1), (1, 2)]
    some, more = ranking.capped(df, [F.asc("a"), F.asc("b")], 4)
    assert some.count() == 4 and more.first().truncated


def test_digest_depends_on_values_not_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k long, v string")
    c = spark.createDataFrame([(2, ""), (1, "x")], "k long, v string")
    one, two, three = (changes.fingerprint(d, ["k", "v"], [], ["k", "v"]).first().digest for d in (a, b, c))
    assert one == two != three


def test_instants(spark):
    row = spark.range(1).select(changes.is_before(F.lit("2024-01-01T00:00:00+02:00"), F.lit("2023-12-31T23:00:00+00:00")).alias("a"), changes.is_before(F.lit("junk"), F.lit("2024-01-01T00:00:00Z")).alias("b")).first()
    assert row.a and not row.b


def test_half_numbers(spark):
    import numpy as np

    from affinia.operators.vectors import half

    xs = [0.0, -0.0, 1.0, 1.0004883, 1.00146484375, 2048.5, 2049.0, 2051.0, 65504.0, 65519.9, 65520.0, -1e9, 6e-8, 2.9e-8, 3e-8, 6.1e-5, 0.1, -0.3333, 5e-324]
    got = [r.h for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(half(F.col("x")).alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert got == np.array(xs).astype(np.float16).astype(float).tolist()
    empty = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(half(F.col("x")).alias("h")).collect()
    assert empty[0].h is None and empty[1].h != empty[1].h


def test_filters_of_nulls_and_marks(spark):
    from affinia.operators import filters

    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 3, None), ("b", 4, True), (None, 5, True), (None, 6, False), ("c", 7, True)], "f string, n int, ok boolean")
    assert sorted(r.n for r in filters.whole_files(rows, "f", F.col("ok")).collect()) == [1, 2, 7]
    found = filters.existing(spark.createDataFrame([("a",), ("z",), (None,)], "f string"), rows, "f")
    assert {r.f: r.found for r in found.collect()} == {"a": True, "z": False, None: False}
    words = spark.createDataFrame([("50%_Off\\",), ("50x_off\\",), ("İ50%_",), (None,)], "w string")
    assert [r.w for r in words.where(filters.containing(F.col("w"), "50%_O")).collect()] == ["50%_Off\\"]
    with pytest.raises(ValueError, match="no such"):
        filters.hiding(rows, ["error"])


def test_answers_that_are_not_whole(spark):
    from affinia.sources import answers

    bodies = ["", "no json", "{}", '{"data":{"Page":{"media":[]}}}', '{"data":{"Page":{"media":[{"id":4,"tags":[{"name":"x"}]},{"id":5,"tags":[]}]}}}', None]
    table = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [tuple(r) for r in answers.anime_tags(table).collect()] == [(4, "x", None, None, False)]
    assert answers.site_ratings(table.withColumn("k", F.lit(1)), "k").count() == 0
    dates = spark.createDataFrame([('{"id":1,"release_date":"","first_air_date":"1999-05-01"}',), ('{"id":2,"release_date":"soon"}',)], "body string")
    assert sorted(tuple(r) for r in answers.details(dates).collect()) == [(1, None, 1999), (2, None, None)]
