"""List pages and film pages of a site: their tokens, what they state, and the harvests that rest on them.

`register` makes `page_tokens(html)` known to SQL: a row for each tag and each text, in order. The readers below
take the same tokens in Arrow batches. A page without a site's own markers isn't read as one: it is null, or
unparsed, never empty.

Defined results: a null page is null (a list page, film ids) or not listed (themes). Entities are decoded, tag names
and attribute names are in lower case, of repeated attributes the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from affinia.functions.text import list_size, name_year
from affinia.operators.shared import stored

START, END, TEXT = "start", "end", "text"
#: A list with more entries is refused, as is one with more pages.
MOST_ENTRIES, MOST_PAGES = 2000, 100
#: A run fails when more than this share of the film pages that loaded can't be read.
FAILURES = 0.10



def _texts(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


LIST_PAGE = _texts("name", "description").add("entries", ArrayType(_texts("slug", "label"))).add("next", StringType())
FILM_IDS = _texts("kind", "tmdb_id")
THEMES = _texts("outcome").add("themes", ArrayType(StringType()))
LISTED, UNPARSED, NOT_LISTED = "listed", "unparsed", "not_listed"


class _Tokens(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        first: dict = {}
        for name, value in attrs:
            first.setdefault(name, value)
        self.found.append((START, tag, first))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((END, tag, {}))

    def handle_data(self, data: str) -> None:
        self.found.append((TEXT, data, {}))


def tokens(html: str) -> list[tuple[str, str, dict]]:
    """(kind, tag or text, attributes) of a page, in order."""
    parser = _Tokens()
    parser.feed(html)
    parser.close()
    return parser.found


class PageTokens:
    """A row for each token of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        for place, (kind, value, attrs) in enumerate(tokens(html or ""), 1):
            text = kind == TEXT
            yield place, kind, None if text else value, value if text else None, {k: v or "" for k, v in attrs.items()} if kind == START else None


def register(spark: SparkSession) -> None:
    """Makes page_tokens(html) a table function of the session's SQL: place, kind, tag, text, attrs."""
    made = F.udtf(PageTokens, returnType="place int, kind string, tag string, text string, attrs map<string,string>")
    spark.udtf.register("page_tokens", made)


def page_tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, place, kind, tag, text, attrs of each page's tokens."""
    register(pages.sparkSession)
    return pages.sparkSession.sql(f"SELECT p.`{key}`, t.* FROM {{pages}} p, LATERAL page_tokens(p.`{html}`) t", pages=pages)


def _plain(text: str) -> str:
    return " ".join(text.split())


def _list_page(html: str | None) -> tuple | None:
    """What a list page states, or None for another page."""
    is_list, name, heading, description, entries, following = False, None, None, None, [], None
    for kind, value, attrs in tokens(html or ""):
        if kind == START:
            classes = (attrs.get("class") or "").split()
            if value == "body":
                is_list = "list-page" in classes
            elif value == "h1" and "title-1" in classes and name is None:
                heading = []
            elif value == "a" and "next" in classes:
                following = attrs.get("href") or following
            elif value == "meta" and attrs.get("name") == "description":
                # The last description that states a size counts; the caller reads the number.
                text = attrs.get("content") or ""
                description = text if "A list of " in text or description is None else description
            if attrs.get("data-item-slug") and attrs.get("data-item-name"):
                entries.append({"slug": attrs["data-item-slug"], "label": attrs["data-item-name"]})
        elif kind == END and value == "h1" and heading is not None:
            name, heading = _plain("".join(heading)), None
        elif kind == TEXT and heading is not None:
            heading.append(value)
    return (name, description, entries, following) if is_list and name else None


def _film_ids(html: str | None) -> tuple | None:
    """kind and id of a film's page, None for another page; a film without an id counts as a movie."""
    body: dict = {}
    for kind, value, attrs in tokens(html or ""):
        if kind == START and value == "body":
            body = attrs
    number = body.get("data-tmdb-id") or None
    if body.get("data-type") != "film" or (number and not (number.isascii() and number.isdigit())):
        return None
    return ("show" if body.get("data-tmdb-type") == "tv" else "movie", number)


def _themes(html: str | None, tmdb_id: str | None) -> tuple:
    """The themes under their heading; unparsed without the film's marker, or with theme links but none in place."""
    if html is None:
        return (NOT_LISTED, [])
    marker, found, links = None, [], 0
    heading, label, after, depth = None, None, False, 0
    for kind, value, attrs in tokens(html):
        if kind == TEXT:
            for open_ in (heading, label):
                if open_ is not None:
                    open_.append(value)
        elif kind == START:
            if value == "body":
                marker = attrs.get("data-tmdb-id")
            elif value == "h3":
                heading, after = [], False
            elif value == "div":
                if depth or (after and "text-sluglist" in (attrs.get("class") or "")):
                    depth += 1
            elif value == "a" and (attrs.get("href") or "").startswith(("/films/theme/", "/films/mini-theme/")):
                links += 1
                label = [] if depth else label
        elif value == "h3" and heading is not None:
            after, heading = "".join(heading).strip() == "Themes", None
        elif value == "a" and label is not None:
            found.append(_plain("".join(label)))
            label = None
        elif value == "div" and depth:
            depth -= 1
            after = after and depth > 0
    themes = list(dict.fromkeys(x for x in found if x))
    if marker is None or marker != tmdb_id or (links and not themes):
        return (UNPARSED, [])
    return (LISTED, themes)


def _frame(rows: list, kind: StructType) -> pd.DataFrame:
    return pd.DataFrame([r if r is not None else (None,) * len(kind.names) for r in rows], columns=kind.names, dtype=object)


@F.pandas_udf(LIST_PAGE)
def _list_pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame([_list_page(h) for h in batch], LIST_PAGE)


@F.pandas_udf(FILM_IDS)
def _film_pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame([_film_ids(h) for h in batch], FILM_IDS)


@F.pandas_udf(THEMES)
def _theme_pages(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, tmdb_id in batches:
        yield _frame([_themes(h, i) for h, i in zip(html, tmdb_id, strict=True)], THEMES)


def _dealt(pages: DataFrame) -> DataFrame:
    """pages over all tasks: a small file holds more pages than one task should read."""
    spark = pages.sparkSession
    return pages.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def read_lists(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, name, size, entries (slug, title, year), next of each list page; name is null for another page. pages: html."""
    p = _dealt(pages).select(*keep, _list_pages("html").alias("p"))
    entries = F.transform("p.entries", lambda e: F.struct(e["slug"].alias("slug"), name_year(e["label"])["name"].alias("title"), name_year(e["label"])["year"].alias("year")))
    return p.select(*keep, F.col("p.name").alias("name"), list_size(F.col("p.description")).alias("size"), entries.alias("entries"), F.col("p.next").alias("next"))


def read_films(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, kind, tmdb_id of each film's page; kind is null for another page. pages: html."""
    return _dealt(pages).select(*keep, _film_pages("html").alias("p")).select(*keep, F.col("p.kind").alias("kind"), F.col("p.tmdb_id").alias("tmdb_id"))


def read_themes(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, outcome, themes of each film's page. pages: html, tmdb_id."""
    return _dealt(pages).select(*keep, _theme_pages("html", "tmdb_id").alias("p")).select(*keep, F.col("p.outcome").alias("outcome"), F.col("p.themes").alias("themes"))


def theme_facts(pages: DataFrame, failures: float = FAILURES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of film pages (item_id, tmdb_id, html; null for a film that isn't listed): facts, cursors, and one row for the run.

    facts: item_id, value, rank. cursors: item_id, matched; a page that can't be read writes none, so that it is
    asked for again. run: fetched, not_listed, matched, unparsed, failed; it failed when more than a share
    of the pages that loaded can't be read.
    """
    read = stored(read_themes(pages, "item_id"), "themes")
    facts = read.where(F.col("outcome") == LISTED).select("item_id", F.posexplode("themes").alias("at", "value")).select("item_id", "value", (F.col("at") + 1).alias("rank"))
    matched = F.size("themes") > 0
    cursors = read.where(F.col("outcome") != UNPARSED).select("item_id", matched.alias("matched"))
    bad = F.count_if(F.col("outcome") == UNPARSED)
    loaded = F.count_if(F.col("outcome") != NOT_LISTED)
    run = read.agg(
        F.count_if(F.col("outcome") != UNPARSED).alias("fetched"),
        F.count_if(F.col("outcome") == NOT_LISTED).alias("not_listed"),
        F.count_if((F.col("outcome") == LISTED) & matched).alias("matched"),
        bad.alias("unparsed"),
        F.coalesce(bad / F.nullif(loaded, F.lit(0)) > failures, F.lit(False)).alias("failed"),
    )
    return facts, cursors, run


def followed(lists: DataFrame, pages: DataFrame) -> DataFrame:
    """list, page, name, size, entries, next: each list's first page and those that it leads to. lists: list, path; pages: path, html.

    Links are followed by doubling: a round adds the pages that lie as far behind the reached ones as those go, so
    that there are as many rounds as the longest list's pages have binary digits. Only paths and numbers are joined, and
    by shuffles, as a broadcast in each round would pass the driver; the count of reached pages is all that it gets. A
    link to a page that its list had before, or that isn't there, ends the list: the last row's next is then not null.
    """
    read = stored(read_lists(pages, "path"), "pages")
    there = read.select("path").distinct()
    link = read.where("name IS NOT NULL AND next IS NOT NULL").select("path", F.col("next").alias("to"))
    jump = stored(link.distinct().hint("merge").join(there.withColumnRenamed("path", "to"), "to", "left_semi").select("path", "to"), "jump")
    reached = stored(lists.hint("merge").join(there, "path", "left_semi").groupBy("list", "path").agg(F.lit(1).alias("page")), "reached")
    span, count, before = 1, reached.count(), 0
    while count > before:
        further = reached.hint("merge").join(jump, "path").select("list", F.col("to").alias("path"), (F.col("page") + span).alias("page"))
        reached = stored(reached.unionByName(further).groupBy("list", "path").agg(F.min("page").alias("page")), "reached")
        count, before = reached.count(), count
        if count > before:
            onward = jump.select(F.col("path").alias("to"), F.col("to").alias("end"))
            jump, span = stored(jump.hint("merge").join(onward, "to").select("path", F.col("end").alias("to")).distinct(), "jump"), 2 * span
    return reached.hint("merge").join(read, "path").select("list", "page", "name", "size", "entries", "next")


def harvested(lists: DataFrame, pages: DataFrame, films: DataFrame, known: DataFrame, most: int = MOST_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The entries of lists, and what became of each list.

    lists: list, path; pages: path, html; films: slug, html; known: kind, tmdb_id, item_id. entries: list, rank, namespace,
    value, item_id: a film with an id has it under tmdb, one without under its own slug; item_id is null if it
    isn't held. outcomes: list, name, entries, outcome ("harvested", or why none of it is written): "missing" without
    a first page, "not_a_list" if any page lacks the markers, "broken" if it leads to no page or back, "short" if
    there are fewer entries than it states, "too_long" with more than most entries or MOST_PAGES pages. Repeated films of a list count once, where they come first.
    All joins are by shuffles: their sides grow with the input, and stored pages are small on disk only, so that Spark
    would send them through the driver.
    """
    read = stored(followed(lists, pages), "followed")
    last = F.max_by("next", "page")
    of_list = read.groupBy("list").agg(
        F.min_by("name", "page").alias("name"),
        F.min_by("size", "page").alias("size"),
        F.sum(F.size(F.coalesce("entries", F.array()))).alias("entries"),
        F.max(F.col("name").isNull()).alias("bad"),
        last.isNotNull().alias("open"),
        F.max("page").alias("pages"),
    )
    why = F.when(F.col("entries").isNull(), "missing").when(F.col("bad"), "not_a_list").when(F.col("open"), "broken").when((F.col("entries") > most) | (F.col("pages") > MOST_PAGES), "too_long").when(F.col("entries") < F.col("size"), "short").otherwise("harvested")
    outcomes = stored(lists.select("list").hint("merge").join(of_list, "list", "left").select("list", "name", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), why.alias("outcome")), "outcomes")
    good = outcomes.where(F.col("outcome") == "harvested").select("list")
    each = read.hint("merge").join(good, "list", "left_semi").select("list", "page", F.posexplode("entries").alias("at", "e")).groupBy("list", F.col("e.slug").alias("slug")).agg(F.min(F.struct("page", "at")).alias("first"))
    ids = read_films(films, "slug").where("kind IS NOT NULL")
    named = each.hint("merge").join(ids, "slug", "left")
    value = F.when(F.col("tmdb_id").isNull(), F.struct(F.lit("page").alias("namespace"), F.col("slug").alias("value"))).otherwise(F.struct(F.lit("tmdb").alias("namespace"), F.col("tmdb_id").alias("value")))
    held = named.hint("merge").join(known, ["kind", "tmdb_id"], "left").select("list", "first", value.alias("v"), "item_id")
    # A list's films are MOST_ENTRIES at most, so its ranks are one small window.
    once = held.groupBy("list", "v").agg(F.min("first").alias("first"), F.min("item_id").alias("item_id"))
    rank = F.row_number().over(Window.partitionBy("list").orderBy("first")).alias("rank")
    return once.select("list", rank, "v.namespace", "v.value", "item_id"), outcomes

