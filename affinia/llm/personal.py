"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers. These are the first seeds. The
words around a seed, and around any other token of a plausible shape, are lexical patterns: the word
before, the two words before, the word behind, and the words on both sides. Spark scores the graph of
patterns and instances in rounds: a pattern of a kind is as good as the mean of its instances, an instance
that isn't a seed is as good as the mean of its patterns. A pattern with enough distinct seeds and a high
score is one of high confidence. An instance of which such patterns leave little doubt (the product of what
each leaves), and which has a shape of their kind, is a seed in the next round, so that its other patterns
gain too. In the end, patterns of high confidence mark the tokens in them as identifiers of their
kind. A pattern with one instance says what the instance says, and is left out.

The texts are read once; what is found in them is stored, and the graph is made from that by grouping
and joins, whose hot keys Spark can split. Nothing of it reaches the driver.

Defined results: a null or empty text has no spans. Each row counts on its own, also if ids repeat or
are null. Offsets are code points, the end is exclusive. An added span never overlaps one of the fixed
patterns. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The patterns that the contract states.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: EMAIL's two sides, and runs of digits and dots.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_AT = re.compile(r"@|[(\[{]at[)\]}]", re.IGNORECASE)
_GROUPS = re.compile(r"[0-9A-Fa-f]+([.:]+[0-9A-Fa-f]+){2,}")
_WHITE = " \t\n\x0b\x0c\r"
#: What a plausible token has somewhere, and groups of digits with blanks between them.
_SIGN = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.IGNORECASE)
_SPACED = re.compile(r"[+(]?[0-9][0-9()./+-]*(?:\x20[0-9(][0-9()./+-]*)+")
_WORD, _DIGIT = re.compile(r"[^\x20\x09-\x0D]+"), re.compile("[0-9]")
_EDGES = "\"'`.,;:!?()[]{}<>|="

#: Rounds of scoring; a pattern is of high confidence with so many distinct seeds and this score at least.
ROUNDS, SEEDS, LEAST = 4, 5, 0.6
#: The doubt that an instance may leave to become a seed.
DOUBT = 0.1
#: Words with more characters are all alike in a pattern.
LONG = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's matches; each "@" is tried once with all that can stand before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in IP.finditer(text, *run.span()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each match, in that order."""
    found = []
    for kind, finder in enumerate((_emails, _ips, _cards, _phones)):
        found += [(start, kind, end) for start, end in finder(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class Words:
    """The words of a text, and which stand before and behind a span."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def _plain(self, start: int, end: int) -> str:
        """In lower case, digits alike."""
        return _DIGIT.sub("0", self.text[start:end].lower()) if end - start <= LONG else "\0"

    def before(self, start: int) -> list[str]:
        """Up to two words, the nearest first; the part of a word that touches the span is one."""
        i = bisect_left(self.starts, start)
        return [self._plain(self.starts[k], min(self.ends[k], start)) for k in (i - 1, i - 2) if k >= 0]

    def behind(self, end: int) -> list[str]:
        i = bisect_right(self.ends, end)
        return [self._plain(max(self.starts[i], end), self.ends[i])] if i < len(self.ends) else []

    def patterns(self, start: int, end: int) -> list[str]:
        left, right = self.before(start), self.behind(end)
        out = [f"< {w}" for w in left[:1]] + [f"<< {left[1]} {left[0]}" for _ in left[1:]] + [f"> {w}" for w in right]
        return out + [f"<> {left[0]} {right[0]}" for _ in left[:1] if right]


def plausible(token: str) -> bool:
    """An @ or (at) within, groups with dots or colons, or four digits in all."""
    if sum("0" <= c <= "9" for c in token) >= 4:
        return True
    m = _AT.search(token)
    return bool(m and 0 < m.start() and m.end() < len(token)) or bool(_GROUPS.fullmatch(token))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Plausible tokens that touch no span of the fixed patterns."""
    out, last, i = [], -1, 0
    ordered = sorted((s, e) for s, _, e in spans)
    for run in _SIGN.finditer(text):
        if run.start() < last:
            continue
        start, end = run.span()
        while start > 0 and text[start - 1] not in _WHITE:
            start -= 1
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        m = _SPACED.match(text, start)
        if m and sum("0" <= c <= "9" for c in m[0]) <= 19:
            end = max(end, m.end())
        last = end
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while i < len(ordered) and ordered[i][1] <= start:
            i += 1
        if end > start and plausible(text[start:end]) and not any(s < end and e > start for s, e in ordered[i : i + 8]):
            out.append((start, end))
    return out


_SEEN = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, seen array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"
_SEEN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: its counts, its spans, and each seed and candidate with its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, seen = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                bases.append(joined(spans))
                tokens = [(k, s, e) for s, k, e in spans] + [(None, s, e) for s, e in candidates(text, spans)]
                words = Words(text) if tokens else None
                seen.append([{"kind": k, "start": s, "end": e, "value": text[s:e].lower(), "patterns": words.patterns(s, e)} for k, s, e in tokens])
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.record_batch([batch.column(0), batch.column(1), *numbers, pa.array(bases, pa.string()), pa.array(seen, _SEEN_TYPE)], ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, _SEEN)


def _best(score: str | Column = "score") -> Column:
    """The kind with the highest score, the first one on ties."""
    return F.max(F.struct(score, (-F.col("kind")).alias("minus"))).alias("best")


def fits() -> Column:
    """Whether value has a shape of kind: an @ or (at) for e-mail alone, without one four digits or groups."""
    at, many = F.col("value").rlike(rf"(?i){_AT.pattern}"), F.length(F.regexp_replace("value", "[^0-9]", "")) >= 4
    return F.when(at, F.col("kind") == 0).when(many, F.col("kind") != 0).otherwise(F.col("kind") == 1)


def bootstrapped(tokens: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, least: float = LEAST, doubt: float = DOUBT) -> DataFrame:
    """pattern, kind, score of the patterns of high confidence. tokens has kind (null for candidates), value, pattern."""
    edges = stored(tokens.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")).drop("n"), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.count("kind").alias("known")).where("size > 1")
    # A candidate's share in a pattern: patterns of candidates alone are needed too, as some of these become seeds.
    fixed = stored(edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")), "fixed")
    tied = edges.where("kind IS NULL").select("pattern", "value").join(sizes.select("pattern", "size"), "pattern")
    tied = stored(tied.join(tied.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value"), "tied")
    scored = fixed.join(sizes.select("pattern", "size"), "pattern").select("pattern", "kind", (F.col("seeds") / F.col("size")).alias("score"), "seeds")
    scored = stored(scored, "scored")
    for _ in range(rounds if not tied.isEmpty() else 0):
        sure = (F.col("seeds") >= seeds) & (F.col("score") >= least)
        left = F.exp(F.sum(F.when(sure, F.log(1 - F.least("score", F.lit(0.999999)))).otherwise(0.0))).alias("doubt")
        met = tied.join(scored, "pattern").where(fits()).groupBy("value", "kind").agg((F.sum("score") / F.first("n")).alias("score"), left)
        best = met.groupBy("value").agg(_best((-F.col("doubt")).alias("score"))).where(F.col("best.score") >= -doubt).select("value", (-F.col("best.minus")).alias("kind"), F.lit(1).alias("seed"))
        good = stored(met.join(best, ["value", "kind"], "left").select("value", "kind", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("score")).alias("good"), F.coalesce("seed", F.lit(0)).alias("seed")), "instances")
        more = tied.select("pattern", "value", "size").join(good, "value").groupBy("pattern", "kind").agg(F.first("size").alias("size"), F.sum("good").alias("good"), F.sum("seed").alias("more"))
        base = fixed.join(sizes.select("pattern", F.col("size").alias("own")), "pattern")
        count = lambda c: F.coalesce(F.col(c), F.lit(0))
        both = base.join(more, ["pattern", "kind"], "full").withColumn("score", (count("seeds") + count("good")) / F.coalesce("size", "own"))
        scored = stored(both.select("pattern", "kind", "score", (count("seeds") + count("more")).alias("seeds")), "scored")
    found = scored.where((F.col("seeds") >= seeds) & (F.col("score") >= least)).groupBy("pattern").agg(_best())
    return found.select("pattern", (-F.col("best.minus")).alias("kind"), F.col("best.score").alias("score"))


def find(docs: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, least: float = LEAST) -> DataFrame:
    """doc_id, counts of the fixed patterns, base (their spans), spans (all spans) and n_spans (how many) of each row."""
    seen = stored(scan(docs), "seen")
    each = seen.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    tokens = each.select("row", "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))
    good = stored(bootstrapped(tokens.select("kind", "value", "pattern"), rounds, seeds, least), "good")
    added = tokens.where("kind IS NULL").drop("kind").join(good, "pattern").where(fits())
    one = added.groupBy("row", "start", "end").agg(_best())
    more = one.select("row", F.struct("start", (-F.col("best.minus")).alias("kind"), "end").alias("span")).groupBy("row").agg(F.collect_list("span").alias("more"))
    own = F.transform(F.filter("seen", lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(F.concat(own, "more")), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(text, ","))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    total = sum((F.col(c) for c in counts), F.lit(0)) + F.coalesce(F.size("more"), F.lit(0))
    return seen.join(more, "row", "left").select("doc_id", *counts, "base", spans.alias("spans"), total.cast("long").alias("n_spans"))
