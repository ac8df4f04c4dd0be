"""Facts of HTML pages: titles, links and visible text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def language(html: Column) -> Column:
    return F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1)


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, href of each link."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*\bhref="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("at", "href")).select("page_id", (F.col("at") + 1).cast("long").alias("place"), "href")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(StringType())
def visible_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text outside of scripts and styles, entities decoded, white space collapsed."""

    def one(html: str | None) -> str | None:
        if html is None:
            return None
        parser = _Text()
        parser.feed(html)
        parser.close()
        return " ".join("".join(parser.parts).split())

    for batch in batches:
        yield batch.map(one, na_action="ignore")
