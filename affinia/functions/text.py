"""Spellings, keywords, names, paths and URLs as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are never folded, the hosts of lists, and the priority of ids.
NEVER_FOLD = ("aids", "alps", "arms", "cruces", "customs", "falls", "interspecies", "it's", "las", "mars", "ops", "ss", "states", "vis", "wales", "woods")
LIST_HOSTS = ("mdblist.com", "letterboxd.com")
ID_PRIORITY = ("imdb", "tmdb", "tvdb", "plex")


#: A character of a word, in any script.
_WORD = r"[\p{L}\p{N}_]"


def surface(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fold_plural(word: Column) -> Column:
    """The singular by a few rules of English spelling; no dictionary is used, so rare words may differ."""
    n = F.char_length(word)
    return (
        F.when(word.isin(*NEVER_FOLD) | (n < 4) | word.rlike("(ics|news|eries|ecies)$"), word)
        .when(word.rlike("[^aeiou]ies$"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike("(s|x|ch|sh)es$"), F.substring(word, F.lit(1), n - 2))
        .when(word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("s$"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def keyword(text: Column) -> Column:
    """The stored form of a keyword: words broken at white space, dashes and connectors, edges stripped, plurals folded."""
    plain = F.regexp_replace(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), r"[\s\p{Pd}\p{Pc}]+", " ")
    edge = r"[\p{P}\p{Cf}\p{M}&&[^#%]]+"
    words = F.transform(F.split(plain, " "), lambda w: F.regexp_replace(F.regexp_replace(w, f"^{edge}", ""), f"{edge}$", ""))
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), fold_plural), " ")


def guid(text: Column) -> Column:
    """namespace and value of an id such as imdb://tt1."""
    parts = F.split(text, "://", 2)
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("namespace"), F.get(parts, F.lit(1)).alias("value")))


def label(title: Column, year: Column, show: Column, season: Column, episode: Column) -> Column:
    """Show S01E02: Title, or Title (Year), or Title."""
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    of_show = F.concat(show, F.lit(" S"), two(season), F.lit("E"), two(episode), F.lit(": "), title)
    return F.coalesce(of_show, F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")")), title)


def name_year(text: Column) -> Column:
    """name and year of "Title (2001)"; no year otherwise."""
    pattern = r"(?s)^(.*) \(([0-9]{4})\)\z"
    year = F.regexp_extract(text, pattern, 2)
    return F.struct(F.when(year != "", F.regexp_extract(text, pattern, 1)).otherwise(text).alias("name"), F.when(year != "", year.cast("int")).alias("year"))


def list_size(text: Column) -> Column:
    """The number in "A list of 1,234 films" or "A list of 1 film", where these are whole words in this spelling."""
    digits = F.regexp_extract(text, rf"(?<!{_WORD})A list of ([0-9,]+) films?(?!{_WORD})", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("long")


def canonical_list_url(url: Column, hosts: Sequence[str] = LIST_HOSTS) -> Column:
    """https://host/path in lower case, without query, fragment, page and final slash; null for other hosts."""
    host = F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("PATH"))), r"/page/\d+/?$", ""), r"/+$", "")
    return F.when(host.isin(*hosts) & (path != ""), F.concat(F.lit("https://"), host, path))


def canonical_path(path: Column, roots: Sequence[str]) -> Column:
    """The path behind the longest root that ends at one of its slashes, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.when(F.lit(False), plain)
    for root in sorted({r.replace("\\", "/").rstrip("/") for r in roots}, key=lambda r: (-len(r), r)):
        out = out.when(plain == root, F.lit("")).when(F.startswith(plain, F.lit(root + "/")), F.substring(plain, F.lit(len(root) + 2), F.char_length(plain)))
    return out.otherwise(plain)


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits, in 16 hexadecimal digits."""

    known = text.dropna()
    rows = [s.encode() for s in known]
    sizes = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-sizes, kind="stable")  # the longest first: those still running are a prefix
    starts, data = (np.cumsum(sizes) - sizes)[order], np.frombuffer(b"".join(rows), np.uint8)
    hashes, left = np.full(len(rows), 0xCBF29CE484222325, np.uint64), sizes[order]
    for k in range(int(sizes.max(initial=0))):  # one step for each position, all rows together
        n = int(np.searchsorted(-left, -k, "left"))
        hashes[:n] = (hashes[:n] ^ data[starts[:n] + k]) * np.uint64(0x100000001B3)
    out = pd.Series([None] * len(rows), index=known.index, dtype=object)
    out.iloc[order] = [f"{h:016x}" for h in hashes.tolist()]
    return out.reindex(text.index).where(text.notna(), None)


def item_id(ids: Mapping[str, Column], path: Column) -> Column:
    """The first id that isn't blank, by priority, else a hash of the path."""
    found = [F.when(F.trim(ids[n]) != "", F.concat(F.lit(f"{n}:"), ids[n])) for n in ID_PRIORITY if n in ids]
    return F.coalesce(*found, F.concat(F.lit("fs:"), fnv1a(path)))


def clock(ms: Column) -> Column:
    """h:mm:ss.t of milliseconds."""
    tenths = F.floor(ms / 100)
    parts = [F.floor(tenths / 36000), F.floor(tenths / 600) % 60, F.floor(tenths / 10) % 60, tenths % 10]
    text = [p.cast("string") for p in parts]
    return F.concat(text[0], F.lit(":"), F.lpad(text[1], 2, "0"), F.lit(":"), F.lpad(text[2], 2, "0"), F.lit("."), text[3])


def requested_seconds(header: Column, usual: float = 60.0) -> Column:
    """The seconds that a Retry-After header asks for; the usual wait where it isn't a number."""
    plain = F.lower(F.regexp_replace(header, r"^\s+|\s+\z", ""))
    number = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z"), plain.try_cast("double"))
    endless = F.when(plain.rlike(r"^[+]?inf(inity)?\z"), F.lit(float("inf"))).when(plain.rlike(r"^-inf(inity)?\z"), F.lit(float("-inf")))
    return F.coalesce(number, endless, F.lit(usual))


def retry_after(header: Column, usual: float = 60.0, most: float = 120.0) -> Column:
    """The seconds to wait, at least one; null where more than the most are asked for and the request is given up."""
    asked = requested_seconds(header, usual)
    return F.when(asked <= most, F.greatest(asked, F.lit(1.0)))


def parsed(name: Column, rules: Sequence[tuple[str, str, int]]) -> dict[str, Column]:
    """Fields of a file name: for each, the first rule (field, pattern, group) that matches."""
    out: dict[str, list[Column]] = {}
    for field, pattern, group in rules:
        hit = F.regexp_extract(name, pattern, group)
        out.setdefault(field, []).append(F.when(hit != "", hit))
    return {field: F.coalesce(*hits) for field, hits in out.items()}


def path_segment(text: Column) -> Column:
    """A part of a path without characters that file systems refuse."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    return F.regexp_replace(clean, r"[. ]+$", "")


def percent_plain(text: Column) -> Column:
    """A path with its percent-encoding undone, a plus sign as it is; one that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def role_of(category: Column, roles: Mapping[str, str]) -> Column:
    """The role of the nearest of a category and its ancestors ("Setting-Time" before "Setting") that has one."""
    parts = F.split(category, "-")
    table = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    nearest = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    hits = F.transform(nearest, lambda n: F.try_element_at(table, F.array_join(F.slice(parts, F.lit(1), n), "-")))
    return F.try_element_at(F.filter(hits, lambda x: x.isNotNull()), F.lit(1))


def inside_hours(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in a window that may wrap midnight; equal ends are the whole day."""
    if start == end:
        return hour.isNotNull()
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def as_int(value: Column) -> Column:
    """An integer from JSON text: whole numbers, true and false; null for anything else."""
    return F.when(value == "true", 1).when(value == "false", 0).when(value.rlike(r"^-?[0-9]+(\.0+)?$"), F.regexp_replace(value, r"\..*$", "").cast("long")).cast("long")


def truthy(value: Column) -> Column:
    """Whether JSON text stands for something: not null, false, zero, or an empty string, list or object."""
    return F.coalesce(~value.isin("", "null", "false", '""', "[]", "{}") & ~value.rlike(r"^-?0+(\.0+)?$"), F.lit(False))


# The decoders whose lines count, the words that tell of damage, and a message of the set-up that doesn't.
DECODERS = (
    "hevc",
    "h264",
    "av1",
    "vp8",
    "vp9",
    "mpeg1video",
    "mpeg2video",
    "mpeg4video",
    "mpeg4",
    "vc1",
    "wmv1",
    "wmv2",
    "wmv3",
    "msmpeg4v1",
    "msmpeg4v2",
    "msmpeg4v3",
    "mjpeg",
    "prores",
    "dnxhd",
    "theora",
)
DAMAGE = ("invalid", "error", "outside the valid range", "undecodable", "concealing")
SET_UP = "failed setup for format"


def decoder_lines(log: Column) -> Column:
    """damage and other of a decoder's log: the lines of a video decoder that tell of damage, and how many others there are."""
    lines = F.filter(F.transform(F.split(log, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")
    of_video = rf"^\[({'|'.join(DECODERS)}){_WORD}*\s*@"

    def damaged(x: Column) -> Column:
        low = F.lower(x)
        return x.rlike(of_video) & ~F.contains(low, F.lit(SET_UP)) & low.rlike("|".join(DAMAGE))

    damage = F.filter(lines, damaged)
    return F.struct(damage.alias("damage"), (F.size(lines) - F.size(damage)).cast("long").alias("other"))


def damage_lines(log: Column) -> Column:
    """How many lines of a decoder's log tell of damage."""
    return F.size(decoder_lines(log)["damage"]).cast("long")


def robots_pattern(rule: str) -> str:
    """A robots.txt path as a regular expression: * is anything, a final $ is the end."""
    import re

    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + end


def robots_allowed(path: Column, allow: Sequence[str], disallow: Sequence[str]) -> Column:
    """Whether the longest rule that matches allows the path; allow wins ties, no rule allows."""
    path = percent_plain(path)

    def longest(rules: Sequence[str]) -> Column:
        hits = [F.when(path.rlike(robots_pattern(r)), F.lit(len(r.encode()))).otherwise(F.lit(-1)) for r in rules if r]
        return F.greatest(*hits, F.lit(-1), F.lit(-1))

    return longest(allow) >= longest(disallow)


def rendered(template: str, fields: Mapping[str, Column]) -> Column:
    """A path from a template such as "{library}/{title}": each field cleaned as a part of a path; null if a field is."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[path_segment(fields[p]) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
