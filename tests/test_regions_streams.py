"""Regions of a map, the SQL box's guard, pages and their harvests, and the streams, against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from affinia.functions import text as T
from affinia.operators import ranking, regions
from affinia.plans import sqlbox
from affinia.plans.registry import QUERIES
from affinia.sources import pages
from affinia.streaming import resolved as streams

SF = "/root/testdata/sf0.001"


# --- places and regions -----------------------------------------------------------------------------


def test_places_in_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaaab"), rnd.randint(0, 40), i) for i in range(500)]
    got = ranking.placed_in_group(spark.createDataFrame(rows, "g string, v int, id int").repartition(7), ["g"], [F.col("v"), F.col("id")]).collect()
    want = {}
    for g in "ab":
        some = sorted((v, i) for h, v, i in rows if h == g)
        want |= {i: (k, len(some)) for k, (_, i) in enumerate(some)}
    assert {r.id: (r.place, r["size"]) for r in got} == want


def named_regions(points, tagged, exclude, first, last, least):
    """By hand: the cells from the top, each named by its best tag that names none above."""
    df = Counter(t for _, t in tagged)
    titles = len({i for i, _ in tagged})
    of = defaultdict(list)
    for i, t in tagged:
        if t is not None and df[t] >= 2 and t not in exclude:
            of[i].append(t)
    out, todo = {}, [(0, sorted(points), frozenset())]
    while todo:
        node, some, used = todo.pop()
        depth = (node + 1).bit_length() - 1
        if depth > last or len(some) < least:
            continue
        if depth >= first:
            counts = Counter(t for i, _, _ in some for t in of[i])
            free = [(-n * (1 + math.log(titles / df[t])), t) for t, n in counts.items() if n >= max(2, 0.05 * len(some)) and t not in used]
            if free:
                tag = min(free)[1]
                spans = []
                for axis in (1, 2):
                    v = sorted(p[axis] for p in some)
                    spans.append((v[len(v) // 2], v[int(0.9 * (len(v) - 1))] - v[int(0.1 * (len(v) - 1))]))
                out[node] = (round(spans[0][0], 4), round(spans[1][0], 4), round(spans[0][1], 4), round(spans[1][1], 4), len(some), tag)
                used = used | {tag}
        axis = 1 if max(p[1] for p in some) - min(p[1] for p in some) >= max(p[2] for p in some) - min(p[2] for p in some) else 2
        some = sorted(some, key=lambda p: (p[axis], p[0]))
        todo += [(2 * node + 1, some[: len(some) // 2], used), (2 * node + 2, some[len(some) // 2 :], used)]
    return out


@pytest.mark.parametrize(("n", "in_task", "last"), [(700, 1 << 20, 9), (700, 60, 5), (9, 1, 9), (0, 10, 9)])
def test_regions(spark, n, in_task, last):
    """Cut in one task, and level by level; many equal coordinates, items without tags, tags without points, nulls."""
    rnd = random.Random(n)
    points = [(f"t{i:03}", rnd.choice([0.5, 1.25, rnd.random() * 3]), rnd.choice([2.0, rnd.random()])) for i in range(n)]
    tags = [f"g{k}" for k in range(25)]
    tagged = {(i, rnd.choice(tags[: rnd.randint(1, 25)])) for i, _, _ in points for _ in range(rnd.randint(0, 5))} | {("elsewhere", "g1"), ("t001", "once"), ("t002", None)}
    table = spark.createDataFrame([*points, ("t900", None, 1.0)], "item string, x double, y double")
    got = regions.region_labels(table, spark.createDataFrame(sorted(tagged, key=str), "item string, tag string"), ["g0", "g3"], first=0 if n == 9 else 2, last=last, in_task=in_task)
    want = named_regions(points, tagged, {"g0", "g3"}, 0 if n == 9 else 2, last, 8)
    assert {r.node: (r.x, r.y, r.width, r.height, r.titles, r.tag) for r in got.collect()} == want
    assert bool(want) == (n > 0)


# --- SQL box -----------------------------------------------------------------------------------------

REFUSED = [
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT reflect('java.lang.System', 'exit', 1)",
    "SELECT try_reflect('java.lang.System', 'exit', 1)",
    "SELECT id FROM shown WHERE id IN (SELECT value FROM text.`/etc/hostname`)",
    "SELECT (SELECT max(java_method('java.lang.System', 'nanoTime')) FROM shown) AS t",
    "SELECT EXISTS (SELECT 1 FROM hidden.t)",
    "WITH a AS (SELECT * FROM csv.`/etc/hostname`) SELECT * FROM a",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "SELECT * FROM (SELECT * FROM spark_catalog.default.t)",
    "SELECT * FROM STREAM shown",
    "SELECT * FROM read_files('/etc')",
    "SELECT * FROM range(9) WHERE id = :n",
    "SELECT * FROM range(9) WHERE id = ?",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'gc')",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM shown",
    "SELECT input_file_name() FROM shown",
    "SELECT current_user()",
    "SELECT repeat('x', 1000000000)",
    "SELECT repeat('x', id) FROM shown",
    "SELECT explode(sequence(1, id)) FROM shown",
    "SELECT my_udf(id) FROM shown",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'gc'))",
    "SELECT sum(id) OVER (ORDER BY java_method('java.lang.System', 'nanoTime')) FROM shown",
    "SELECT 1; SELECT 2",
    "DROP VIEW shown",
    "CREATE TABLE t AS SELECT 1",
    "INSERT INTO shown VALUES (1)",
    "SET spark.sql.ansi.enabled = false",
    "DESCRIBE shown",
    "EXPLAIN SELECT 1",
    "SHOW TABLES",
    "CACHE TABLE shown",
    "VALUES (reflect('java.lang.System', 'gc'))",
    "SELECT * FROM shown JOIN json.`/etc/hostname` ON true",
    "SELECT * FROM shown LATERAL VIEW reflect('a', 'b') AS x",
    "  ",
]

ALLOWED = {
    "SELECT id FROM shown WHERE id < 3 ORDER BY id": [(0,), (1,), (2,)],
    "WITH a AS (SELECT id FROM shown), b AS (SELECT max(id) AS m FROM a) SELECT m FROM b": [(9,)],
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT sum(n) FROM r": [(10,)],
    "SELECT count(*) FROM shown s JOIN SHOWN t USING (id) WHERE EXISTS (SELECT 1 FROM shown u WHERE u.id = s.id)": [(10,)],
    "SELECT transform(array(1, 2), x -> x + 1), upper('a'), coalesce(null, 3), repeat('ab', 2), CASE WHEN true THEN 1 END": [([2, 3], "A", 3, "abab", 1)],
    "SELECT k, count(*) FROM shown LATERAL VIEW explode(array(1, 2)) AS k GROUP BY k HAVING count(*) > 1 ORDER BY k": [(1, 10), (2, 10)],
    "SELECT id, row_number() OVER w FROM shown WINDOW w AS (ORDER BY id DESC) ORDER BY id LIMIT 1 OFFSET 1": [(1, 9)],
    "VALUES (1, 'x')": [(1, "x")],
    "SELECT 1 UNION SELECT 2 EXCEPT SELECT 2": [(1,)],
    "SELECT * FROM range(2)": [(0,), (1,)],
    "SELECT date_trunc('month', TIMESTAMP '2024-05-06 01:02:03') = TIMESTAMP '2024-05-01 00:00:00', get_json_object('{\"a\":1}', '$.a')": [(True, "1")],
}


@pytest.fixture(scope="module")
def shown(spark):
    spark.range(10).createOrReplaceTempView("shown")
    spark.udf.register("my_udf", lambda x: x)
    yield
    spark.catalog.dropTempView("shown")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, shown, sql):
    with pytest.raises(sqlbox.Refused):
        sqlbox.query(spark, sql)


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, shown, sql):
    assert [tuple(r) for r in sqlbox.query(spark, sql, seconds=60).rows] == ALLOWED[sql]


def test_box_limits(spark, shown):
    with pytest.raises(sqlbox.Refused, match="no table"):
        sqlbox.query(spark, "SELECT * FROM shown", tables=["other"])
    answer = sqlbox.query(spark, "SELECT concat('i', id) AS a, id FROM shown ORDER BY id", rows=4, seconds=60, items=spark.createDataFrame([("i1", "One", 1999), ("i2", "Two", None), ("i9", "Nine", 1)], "item_id string, title string, year int"))
    assert answer.truncated and len(answer.rows) == 4 and answer.labels == {"i1": "One (1999)", "i2": "Two"}
    with pytest.raises(Exception, match="longer than 8388608 bytes"):
        sqlbox.query(spark, "SELECT concat(repeat('x', 8388608), 'y') AS v", seconds=60)


# --- text rules --------------------------------------------------------------------------------------


def test_rules_of_headers_lists_and_logs(spark):
    waits = {"0": 1.0, "junk": 60.0, "30": 30.0, "121": None, "30.5": 30.5, "-5": 1.0, None: 60.0, "\t7\n": 7.0, "120.01": None, "1e3": None, ".5": 1.0, "5d": 60.0, "+8": 8.0, "0x10": 60.0, "Infinity": None, "-inf": 1.0, "nan": 60.0}
    got = spark.createDataFrame([(k,) for k in waits], "h string").select("h", T.retry_after(F.col("h")).alias("s")).collect()
    assert {r.h: r.s for r in got} == waits
    sizes = {"A list of 1 film by x": 1, "Not A list of 3 films": 3, "xA list of 3 films": None, "A list of 3 filmsy": None, "A list of 1,234 films.": 1234, "a list of 3 films": None, "A list of 5 shows": None, "A list of , films": None, "éA list of 2 films": None, "x A list of z. A list of 7 films": 7, None: None}
    got = spark.createDataFrame([(k,) for k in sizes], "h string").select("h", T.list_size(F.col("h")).alias("s")).collect()
    assert {r.h: r.s for r in got} == sizes
    log = "[hevc @ 0x1] first mb outside the valid range\r\n\n  [mpeg4 @ 0x] ERROR  \n[mp3 @ 0x2] invalid data\n[h264_cuvid  @ 0x] undecodable\n[hevc @ 1] Failed setup for format vaapi: error\n[hevc] invalid\n[xvp9 @ 1] error\nerror"
    got = spark.createDataFrame([(log,), ("",), (None,)], "l string").select(T.decoder_lines(F.col("l")).alias("d"), T.damage_lines(F.col("l")).alias("n")).collect()
    assert got[0].d.damage == ["[hevc @ 0x1] first mb outside the valid range", "[mpeg4 @ 0x] ERROR", "[h264_cuvid  @ 0x] undecodable"] and got[0].d.other == 5 and got[0].n == 3
    assert got[1].d.damage == [] and got[1].d.other == 0


# --- pages -------------------------------------------------------------------------------------------

LIST = """<HTML><head><meta name=description content="A list of 1,002 films compiled on X">
<body class="films list-page"><h1 class='title-1 x'> Best &amp; <b>worst</b>
 ever</h1><h1 class="title-1">second</h1><li data-item-slug=heat data-item-name="Heat (1995)"><li data-item-slug="x" data-item-name=""><div data-item-slug="up" data-item-name="Up">
<a class="paginate next" href="/u/list/l/page/2/">Next</a>"""


def test_list_and_film_pages(spark):
    rows = [("a", LIST), ("b", "<body><h1 class='title-1'>x</h1>"), ("c", None), ("d", "<body class='list-page'><h1 class='title-1'> </h1>"), ("e", "<body class=list-page><h1 class=title-1>No size</h1>")]
    got = {r.k: r for r in pages.read_lists(spark.createDataFrame(rows, "k string, html string"), "k").collect()}
    assert (got["a"].name, got["a"]["size"], got["a"].next) == ("Best & worst ever", 1002, "/u/list/l/page/2/")
    assert [tuple(e) for e in got["a"].entries] == [("heat", "Heat", 1995), ("up", "Up", None)]
    assert [got[k].name for k in "bcd"] == [None, None, None] and (got["e"].name, got["e"]["size"], got["e"].entries) == ("No size", None, [])
    films = {"1": ('<body data-type="film" data-tmdb-type="tv" data-tmdb-id="7">', "show", "7"), "2": ("<body data-type=film>", "movie", None), "3": ("<body data-type='person' data-tmdb-id='7'>", None, None), "4": ("<body data-type=film data-tmdb-id='7x'>", None, None), "5": (None, None, None)}
    got = {r.k: (r.kind, r.tmdb_id) for r in pages.read_films(spark.createDataFrame([(k, v[0]) for k, v in films.items()], "k string, html string"), "k").collect()}
    assert got == {k: v[1:] for k, v in films.items()}


def theme_page(marker, heading="Themes", inside="<a href='/films/theme/a/'>A  b</a><a href='/films/mini-theme/a/'>A b</a><a href='/films/theme/c/'>C</a><a href='/x'>no</a>"):
    return f"<body data-tmdb-id='{marker}'><h3>{heading}</h3><div class='text-sluglist'><div>{inside}</div></div><a href='/films/theme/z/'>z</a>"


def test_themes(spark):
    rows = [("i1", "1", theme_page("1")), ("i2", "2", theme_page("3")), ("i3", "3", theme_page("3", "Topics")), ("i4", "4", None), ("i5", "5", '<body data-tmdb-id="5"><h3>Themes</h3>'), ("i6", "6", "<body>")]
    facts, cursors, run = pages.theme_facts(spark.createDataFrame(rows, "item_id string, tmdb_id string, html string"))
    assert sorted(map(tuple, facts.collect())) == [("i1", "A b", 1), ("i1", "C", 2)]
    assert {r.item_id: r.matched for r in cursors.collect()} == {"i1": True, "i4": False, "i5": False}
    assert run.first().asDict() == {"fetched": 3, "not_listed": 1, "matched": 1, "unparsed": 3, "failed": True}
    none = spark.createDataFrame([], "item_id string, tmdb_id string, html string")
    assert pages.theme_facts(none)[2].first().failed is False


def test_a_list_that_leads_in_circles(spark):
    def page(following):
        return f"<body class=list-page><h1 class=title-1>L</h1><li data-item-slug=s data-item-name=S>" + (f"<a class=next href={following}>" if following else "")

    table = spark.createDataFrame([("/1", page("/2")), ("/2", page("/1")), ("/3", page(""))], "path string, html string")
    lists = spark.createDataFrame([("round", "/1"), ("one", "/3")], "list string, path string")
    none = spark.createDataFrame([], "slug string, html string"), spark.createDataFrame([], "kind string, tmdb_id string, item_id string")
    entries, outcomes = pages.harvested(lists, table, *none)
    assert {r.list: (r.entries, r.outcome) for r in outcomes.collect()} == {"round": (2, "broken"), "one": (1, "harvested")}
    assert [tuple(r) for r in entries.collect()] == [("one", 1, "page", "s", None)]
    assert pages.harvested(lists.limit(0), table, *none)[1].count() == 0


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.counts = Counter()

    def handle_starttag(self, tag, attrs):
        self.counts["start", tag] += 1

    def handle_endtag(self, tag):
        self.counts["end", tag] += 1


def test_page_tokens(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    want = {}
    for r in rows:
        parser = Plain()
        parser.feed(r.html or "")
        parser.close()
        want |= {(r.page_id, *k): n for k, n in parser.counts.items()}
    got = QUERIES["page_token_counts"](spark, SF).where("kind <> 'text'").collect()
    assert {(r.page_id, r.kind, r.tag): r.n for r in got} == want
    pages.register(spark)
    found = spark.sql("""SELECT place, kind, coalesce(tag, text) AS v, attrs['a'] AS a FROM page_tokens('<B a=1 a=2>x&lt;y</B>')""").collect()
    assert [tuple(r) for r in found] == [(1, "start", "b", "1"), (2, "text", "x<y", None), (3, "end", "b", None)]


# --- streams -----------------------------------------------------------------------------------------

EVENT = "history_key string, rating_key string, account_id long, viewed_at long"


def test_events_wait_for_their_items_across_restarts(spark, tmp_path):
    """Three runs from one checkpoint: late identities, repeated events, events that lack a field."""
    at = {n: f"file://{tmp_path}/{n}" for n in ("events", "ids", "plays", "checkpoint")}
    for n in ("events", "ids"):
        (tmp_path / n).mkdir()

    def run(events, ids):
        if events:
            spark.createDataFrame(events, EVENT).write.mode("append").parquet(at["events"])
        if ids:
            spark.createDataFrame(ids, "rating_key string, item_id string").write.mode("append").parquet(at["ids"])
        stream = streams.resolved(spark.readStream.schema(EVENT).parquet(at["events"]), spark.readStream.schema("rating_key string, item_id string").parquet(at["ids"]), shares=3)
        streams.written(stream, at["plays"], at["checkpoint"]).awaitTermination()
        plays = spark.read.schema(stream.schema).parquet(at["plays"])
        known = streams.cursor(spark.read.schema(EVENT).parquet(at["events"]), plays).first()
        return sorted((r.history_key, r.item_id) for r in plays.collect()), tuple(known)

    first = [("h1", "r1", 1, 10), ("h2", "r2", 1, 20), ("h3", "r1", 1, 30), ("h1", "r1", 1, 10), ("h4", None, 1, 1), (None, "r1", 1, 1), ("h5", "r1", None, 2)]
    assert run(first, [("r1", "i1"), ("r1", "i9")][:1]) == ([("h1", "i1"), ("h3", "i1")], (20, 1))
    assert run([("h1", "r1", 1, 10), ("h6", "r3", 2, 15)], [("r1", "i1"), ("r4", None)]) == ([("h1", "i1"), ("h3", "i1")], (15, 2))
    assert run([], [("r2", "i2"), ("r3", "i3")]) == ([("h1", "i1"), ("h2", "i2"), ("h3", "i1"), ("h6", "i3")], (30, 0))


def outcomes_by_hand(rows):
    out, held = [], {}
    for file, size, at, result in rows:
        s = held.get(file)
        if s and s["size"] == size and (s["outcome"] in ("done", "failed", "excluded") or at < s["next"]):
            continue
        tries = (s["tries"] if s and s["size"] == size else 0) + 1
        later = at + min(3600 * 2 ** min(tries - 1, 16), 86400) if result == "unreachable" else 0
        held[file] = {"size": size, "outcome": result, "tries": tries, "next": later}
        out.append((file, at, result, tries, later))
    return sorted(out)


def test_outcomes_across_restarts(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), 1 + t // 300000, t, rnd.choice(["unreachable"] * 8 + ["done", "failed"])) for t in range(0, 900000, 1777)]
    ddl = "file string, size long, at long, result string"
    where = {n: f"file://{tmp_path}/{n}" for n in ("in", "out", "at")}
    (tmp_path / "in").mkdir()
    for some in (rows[:100], rows[100:101], rows[101:]):
        spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(where["in"])
        stream = streams.outcomes(spark.readStream.schema(ddl).parquet(where["in"]))
        streams.written(stream, where["out"], where["at"]).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(where["out"]).collect()
    assert sorted(map(tuple, got)) == outcomes_by_hand(rows)
    assert len({r.attempts for r in got}) > 3


def test_stream_outcomes_of_the_tables(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS at", "event_type", "value").collect()
    result = lambda r: {"error": "unreachable", "purchase": "done"}.get(r.event_type, "failed" if r.value > 50 else "unreachable")
    rows = sorted((f"f{r.user_id}", r["at"], r["at"] // 86400, result(r)) for r in events)
    got = QUERIES["stream_outcomes"](spark, SF).collect()
    assert sorted(map(tuple, got)) == outcomes_by_hand([(f, size, at, res) for f, at, size, res in rows])
