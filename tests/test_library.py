"""Text functions, the store, recorded answers, streams and the SQL box."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinia.functions import text as T
from affinia.plans import sqlbox
from affinia.sources import html, recorded
from affinia.sources.store import ShapeError, Store
from affinia.streaming import plays


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "stored"), [("Bank-Heist", "bank heist"), ("bank_heist", "bank heist"), ("Heists", "heist"), ("  (based on) ", "based on"), ("stories", "story"), ("series", "series"), ("boss", "boss"), ("women’s", "women'")])
def test_keyword(spark, raw, stored):
    assert one(spark, T.keyword(F.col("x")), x=raw) == stored


def test_names(spark):
    assert tuple(one(spark, T.name_year(F.col("x")), x="Heat (1995)")) == ("Heat", 1995)
    assert tuple(one(spark, T.name_year(F.col("x")), x="Heat")) == ("Heat", None)
    assert one(spark, T.list_size(F.col("x")), x="A list of 1,234 films compiled") == 1234
    assert tuple(one(spark, T.guid(F.col("x")), x="imdb://tt1")) == ("imdb", "tt1")
    assert one(spark, T.clock(F.lit(3_723_456)), x="") == "1:02:03.4"
    assert one(spark, T.path_segment(F.col("x")), x='a:b "c"  . ') == "a b c"


def test_identity(spark):
    assert one(spark, T.fnv1a(F.col("x")), x="a") == "af63dc4c8601ec8c"
    ids = {"imdb": F.lit(" "), "tmdb": F.lit("5")}
    assert one(spark, T.item_id(ids, F.col("x")), x="p") == "tmdb:5"
    assert one(spark, T.item_id({}, F.col("x")), x="a") == "fs:af63dc4c8601ec8c"
    path = T.canonical_path(F.col("x"), ["/m", "/m/films"])
    assert one(spark, path, x="\\m\\films\\a.mkv") == "a.mkv"
    assert one(spark, path, x="/m") == "" and one(spark, path, x="/mx/a") == "/mx/a"


def test_urls(spark):
    assert one(spark, T.canonical_list_url(F.col("x")), x="http://www.Letterboxd.com/User/list/Best/page/2/?a#b") == "https://letterboxd.com/user/list/best"
    assert one(spark, T.canonical_list_url(F.col("x")), x="https://example.com/a") is None
    allowed = T.robots_allowed(F.col("x"), ["/a/b"], ["/a", "/*.pdf$"])
    assert one(spark, allowed, x="/a/b/c") and not one(spark, allowed, x="/a/c") and not one(spark, allowed, x="/x.pdf") and one(spark, allowed, x="/x.pdfs")


@given(st.text(alphabet="ab*$/.", max_size=8))
def test_robots_pattern_is_always_a_pattern(rule):
    import re

    re.compile(T.robots_pattern(rule))


def test_html(spark):
    page = '<html lang="fr"><title>A &amp; B</title><script>x</script><body>caf&eacute; <a href="/u">l</a></body></html>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.t for r in df.select(html.visible_text("html").alias("t")).collect()] == ["A & Bcafé l", None]
    assert [(r.page_id, r.href) for r in html.links(df).collect()] == [(1, "/u")]


def items(spark, *ids):
    return spark.createDataFrame([(i, "movie") for i in ids], "item_id string, type string").selectExpr("item_id", "type", "'t' title", "'t' sort_title", "2000 year", "null show_item_id", "null season", "null episode", "1L duration_ms", "'l' library")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.publish({"items": items(spark, "a", "b")}) == 1
    assert store.upsert("items", items(spark, "b", "c")) == 2
    assert sorted(r.item_id for r in store.table("items").collect()) == ["a", "b", "c"]
    assert store.table("items", 1).count() == 2 and store.table("plays").count() == 0
    with pytest.raises(ValueError):
        store.publish({"items": items(spark, "a")})
    assert len(store.versions()) == 2
    (next((tmp_path / "s/v2/_meta").glob("part-*"))).write_text(json.dumps({"reader_shape": 99, "tables": []}))
    for crc in (tmp_path / "s/v2/_meta").glob(".part*"):
        crc.unlink()
    with pytest.raises(ShapeError):
        store.table("items")


def test_recorded(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"id": 1, "keywords": [{"id": 2, "name": "x"}, {"id": 3, "name": "y"}]}))
    assert [(r.title, r.keyword, r["rank"]) for r in recorded.keywords(spark, str(tmp_path / "k.json")).collect()] == [(1, "x", 1), (1, "y", 2)]
    (tmp_path / "h.json").write_text(json.dumps({"MediaContainer": {"Metadata": [{"historyKey": "/h/1", "ratingKey": "5", "viewedAt": 9, "accountID": 1, "deviceID": 2, "type": "movie"}]}}))
    assert recorded.history(spark, str(tmp_path / "h.json")).first().viewed_at == 9


def test_stream_retries_unresolved(spark, tmp_path):
    ddl = "history_key string, rating_key string, viewed_at long"
    for n, rows in enumerate(([("1", "a", 10), ("2", "b", 11)], [("1", "a", 10), ("3", "a", 12)])):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = [("a", "item-a")]
    ids = lambda: spark.createDataFrame(known, "rating_key string, item_id string")
    schema = spark.createDataFrame([], ddl).schema

    def go():
        q = plays.ingest(plays.source(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), ids, str(tmp_path / "cp"))
        q.awaitTermination(120)
        return sorted(r.history_key for r in spark.read.parquet(str(tmp_path / "out/plays")).collect())

    assert go() == ["1", "3"]
    known.append(("b", "item-b"))
    spark.createDataFrame([("4", "b", 13)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == ["1", "2", "3", "4"]


def test_windows_agree_with_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2) for m in range(0, 50, 7)]
    df = spark.createDataFrame(rows, "ts string, k int").selectExpr("cast(ts as timestamp) ts", "k")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    want = sorted(map(tuple, plays.windowed_counts(df, "ts", "10 minutes", "1 hour", by=("k",)).collect()))
    streamed = plays.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "10 minutes", "1 hour", by=("k",))
    q = streamed.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == want


@pytest.mark.parametrize("sql", ["", "DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "SET a=b", "nonsense"])
def test_guard_refuses(spark, sql):
    with pytest.raises(sqlbox.Refused):
        sqlbox.query(spark, sql)


def test_box(spark):
    answer = sqlbox.query(spark, "WITH t AS (SELECT id FROM range(20)) SELECT id FROM t ORDER BY id", rows=5)
    assert [r.id for r in answer.rows] == [0, 1, 2, 3, 4] and answer.truncated
    assert sqlbox.panel_value(spark, "SELECT id FROM range(7)", "rows").first().value == 7
    assert sqlbox.panel_value(spark, "SELECT 3 AS n", "column:n").first().value == 3


def test_history_keeps_values(spark):
    ddl = "series string, day string, value double"
    old = spark.createDataFrame([("a", "d1", 1.0), ("a", "d2", 2.0)], ddl)
    new = spark.createDataFrame([("a", "d2", None), ("b", "d2", None), ("a", "d1", 5.0)], ddl)
    assert sorted(map(tuple, sqlbox.recorded(old, new).collect()), key=str) == [("a", "d1", 5.0), ("a", "d2", 2.0), ("b", "d2", None)]
