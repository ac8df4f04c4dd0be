"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A document's paragraphs (its lines that aren't empty, each once) have 64-bit digests. A line of more than
LONG characters is cut into units, runs of words whose borders the hashes of the words pick, so that a
long line edited in one place keeps the digests of its other units. A sketch has cells in three parts; a
digest is counted, and xor-ed with its check, into one cell of each part. Two sketches subtract cell by
cell: what both have cancels out. Peeling then takes digests from cells that hold a single one until nothing
is left: those are the paragraphs that differ, and their number gives the likeness, common paragraphs over all.

Sketches to be subtracted have LEAST cells and ROOM more for each digest of the two texts, so that
nearly all differences peel at once; what gets stuck is tried again with twice the cells, as often as it
takes. A cell is a row: digests go to their cells, and cells are added up, in the task that holds the
document (rows are stored in buckets by it), so that the work grows with the digests and not with the
cells, and no cell crosses a shuffle. A round of peeling looks at one part of the cells, where a digest is once.

A fingerprint is the sketch with CELLS cells, written as text.

Defined results: a null text counts as empty; texts without paragraphs have equal, empty sketches and
likeness 1. `with_next` orders rows by id and takes the next id's text (of repeated ids, the least in
order); after the last id comes the first, and a single id follows itself. A row with a null id has no
next: it is edited with nothing, and its next has no paragraphs. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import bucketed, id_of, ranked, shuffle_parts, stored

#: Cells of a fingerprint. Cells of sketches that are subtracted: some in any case, so that few digests seldom share
#: all three of theirs, and more for each digest.
CELLS, LEAST, ROOM = 24, 96, 10.0
#: Rounds of peeling, a third of the cells each, between two tables.
ROUNDS = 4
#: Buckets for each part of the shuffle: the cells of a bucket are added up in memory.
BUCKETS = 4

#: A line of more characters is cut: after one word in BORDER, by its hash, and after MOST words at least.
LONG, BORDER, MOST = 64, 8, 32
#: A word with the white space behind it. Scripts without blanks have a word for each character; other runs are cut at 32.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_WORDS = rf"(?:[{_ALONE}]|[^\s{_ALONE}]{{1,32}})\s*|\s+"


def _units(line: Column) -> Column:
    """The digests of a long line's units."""

    def of(words: Column) -> Column:
        n = F.size(words)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.xxhash64(F.get(words, i - 1)), F.lit(BORDER)) == 0))

        def between(ends: Column) -> Column:
            def run(end: Column, k: Column) -> Column:
                start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
                return bound(start, lambda a: F.transform(F.sequence(a, end - 1, F.lit(MOST)), lambda at: F.xxhash64(F.slice(words, at + 1, F.least(end - at, F.lit(MOST))))))

            return F.flatten(F.transform(ends, run))

        return bound(ends, between)

    return bound(F.regexp_extract_all(line, F.lit(_WORDS), F.lit(0)), of)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, and of the units of the long ones."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.when(F.char_length(x) > LONG, _units(x)).otherwise(F.array(F.xxhash64(x))))))


def _places(key: Column, cells: int) -> list[Column]:
    part = cells // 3
    return [(F.pmod(F.xxhash64(key, F.lit(k)), F.lit(part)) + k * part).cast("int").alias(f"at{k}") for k in range(3)]


def _entry(key: Column, cells: int) -> Column:
    """A digest with its check and its cell in each of the three parts."""
    return F.struct(key.alias("key"), F.xxhash64(key, F.lit(7)).alias("check"), *_places(key, cells))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """The cells (n, key, check) of an array of digests."""
    part = cells // 3
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def add(acc: Column, e: Column) -> Column:
        return _cell(acc["n"] + 1, acc["key"].bitwiseXOR(e["key"]), acc["check"].bitwiseXOR(e["check"]))

    def one_part(entries: Column, k: int) -> Column:
        def in_cell(i: Column) -> Column:
            return F.aggregate(F.filter(entries, lambda e: e[f"at{k}"] == i), zero, add)

        return F.transform(F.sequence(F.lit(k * part), F.lit(k * part + part - 1)), in_cell)

    return bound(F.transform(keys, lambda key: _entry(key, cells)), lambda entries: F.concat(*[one_part(entries, k) for k in range(3)]))


#: SQL of the number of a cell of part k, for a digest (key) and a number of cells that three divides.
_AT = "CAST(pmod(xxhash64(key, {0}), cells div 3) + {0} * (cells div 3) AS INT)"
#: A cell as a struct, and one that only counts a digest found.
_CELL = "named_struct('at', {0}, 'n', {1}, 'key', key, 'check', check, 'found', 0L)"
_FOUND = "named_struct('at', -1, 'n', 0L, 'key', 0L, 'check', 0L, 'found', 1L)"


def difference(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, at, cells, n, key, check, found: the cells of a minus those of b that aren't empty. pairs: by, a, b (digests), cells.

    Each digest is a row for each of its cells; adding up by cell makes both sketches and their difference in one pass.
    """
    signed = "concat(transform(a, x -> named_struct('key', x, 'n', 1L)), transform(b, x -> named_struct('key', x, 'n', -1L)))"
    each = pairs.selectExpr(*by, "cells", f"inline({signed})")
    parts = ", ".join(_AT.format(k) for k in range(3))
    return _added(each.selectExpr(*by, "cells", "n", "key", "xxhash64(key, 7) AS check", "0L AS found", f"explode(array({parts})) AS at"), by)


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    """The cells that aren't empty, and each pair's count of digests found, at -1."""
    sums = rows.groupBy(*by, "at").agg(*[F.expr(f"{f}({c}) AS {c}") for f, c in (("max", "cells"), ("sum", "n"), ("bit_xor", "key"), ("bit_xor", "check"), ("sum", "found"))])
    return sums.where("n <> 0 OR key <> 0 OR check <> 0 OR found <> 0")


def _round(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """Takes the digests that are alone in a cell of part k out of their other cells, and counts them."""
    alone = f"abs(n) = 1 AND check = xxhash64(key, 7) AND at = {_AT.format(k)}"
    others = ", ".join(_CELL.format(_AT.format(j), "-n") for j in range(3) if j != k)
    same = "named_struct('at', at, 'n', n, 'key', key, 'check', check, 'found', found)"
    return _added(cells.selectExpr(*by, "cells", f"inline(CASE WHEN {alone} THEN array({_FOUND}, {others}) ELSE array({same}) END)"), by)


def _rounds(cells: DataFrame, by: list[str]) -> DataFrame:
    for r in range(ROUNDS):
        cells = _round(cells, by, r % 3)
    return stored(cells, "peeled")


def peeled(cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of differences: by, found (digests recovered, in parts to be added up), and by of those where some can't be.

    The cells left after some rounds are stored and peeled on, few as they are, as long as any round finds something.
    """
    left = _rounds(cells, by)
    found = left.where("at < 0").select(*by, "found")
    left = left.where("at >= 0")
    while not left.isEmpty():
        more = _rounds(left, by)
        left = more.where("at >= 0")
        if more.where("at < 0").isEmpty():
            break
        found = found.unionByName(more.where("at < 0").select(*by, "found"))
    return found, left.select(*by).distinct()


def differing(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, found: how many digests are in one of a and b only, in parts to be added up; no row where none is.

    pairs: by, a, b; stored in buckets of by's first column, so that cells are added up without a shuffle. Pairs that
    get stuck are tried with twice the cells until none is; only whether any is left reaches the driver.
    """
    sized = pairs.withColumn("cells", (F.lit(LEAST) + 3 * F.ceil((F.size("a") + F.size("b")) * ROOM / 3)).cast("int"))
    found, stuck = peeled(difference(sized, by), by)
    times, out = 1, None
    while not stuck.isEmpty():
        times *= 2
        stuck = stored(stuck, "stuck")
        good = found.join(stuck, by, "left_anti")
        out = good if out is None else out.unionByName(good)
        again = sized.join(stuck, by, "left_semi").withColumn("cells", F.col("cells") * times)
        found, stuck = peeled(difference(again, by), by)
    return found if out is None else out.unionByName(found)


def written(cells: Column) -> Column:
    """A sketch as text: the fingerprint."""
    line = lambda c: F.concat(F.hex(c["n"]), F.lit("."), F.lpad(F.hex(c["key"]), 16, "0"))
    return F.array_join(F.transform(cells, line), ":")


def following(ids: DataFrame) -> DataFrame:
    """doc_id, next_id of each distinct id, in ascending order and round."""
    placed = stored(ranked(ids.select("doc_id").distinct(), F.col("doc_id")), "placed")
    n = placed.count()
    after = placed.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("doc_id").alias("next_id"))
    return placed.join(after, "rank").select("doc_id", "next_id")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys (its digests), head (the next text's first quarter of this one's length), next_keys.

    Texts cross one shuffle, by id, which both joins use. Digests are made behind it, once for each join: they would
    take a quarter of the texts' room on disk.
    """
    texts = docs.select(id_of(docs), F.coalesce("text", F.lit("")).alias("text"))
    known = texts.where("doc_id IS NOT NULL")
    sizes = docs.select(id_of(docs), F.char_length(F.coalesce("text", F.lit(""))).alias("n")).where("doc_id IS NOT NULL")
    slim = stored(sizes.groupBy("doc_id").agg(F.max("n").alias("n")), "lengths")
    needs = stored(following(slim).join(slim, "doc_id").select(F.col("next_id").alias("src"), F.col("doc_id").alias("dst"), F.floor(F.col("n") / 4).cast("int").alias("need")), "needs")
    heads = known.join(needs, F.col("doc_id") == F.col("src")).select("dst", F.struct(F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"), digests(F.col("text")).alias("keys")).alias("next"))
    one = heads.groupBy("dst").agg(F.min("next").alias("next"))
    none = F.array().cast("array<bigint>")
    joined = known.join(one, F.col("doc_id") == F.col("dst"), "left").select("doc_id", "text", digests(F.col("text")).alias("keys"), F.coalesce("next.head", F.lit("")).alias("head"), F.coalesce("next.keys", none).alias("next_keys"))
    return joined.unionByName(texts.where("doc_id IS NULL").select("doc_id", "text", digests(F.col("text")).alias("keys"), F.lit("").alias("head"), none.alias("next_keys")))


def _kept(rows: DataFrame) -> DataFrame:
    """rows, stored in buckets of the column bucket (the id, or a number where it is null), each with a number of its own.

    Edited digests begin as the text's own do: only how many are the same, and those that follow, are stored.
    """
    row = F.monotonically_increasing_id()
    same = F.array_position(F.zip_with("keys", "edited_keys", lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
    slim = rows.withColumn("row", row).withColumn("bucket", F.coalesce("doc_id", F.xxhash64("row"))).withColumn("same", F.when(same < 0, F.least(F.size("keys"), F.size("edited_keys"))).otherwise(same))
    slim = slim.withColumn("edited_keys", F.slice("edited_keys", F.col("same") + 1, F.greatest(F.size("edited_keys") - F.col("same"), F.lit(0))))
    kept = bucketed(slim, "digests", "bucket", BUCKETS * shuffle_parts(rows.sparkSession), dealt=True)
    # A row is a group of its own: this keeps Spark reading by bucket, below the explosions that follow.
    kept = kept.groupBy("bucket", "row").agg(*[F.first(c).alias(c) for c in kept.columns if c not in ("bucket", "row")])
    return kept.withColumn("edited_keys", F.concat(F.slice("keys", F.lit(1), F.col("same")), "edited_keys")).drop("same")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("head"), F.lit(1), quarter))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"))
    kept = _kept(rows)
    other = F.explode(F.array(*[F.struct(F.lit(which).alias("which"), F.col(c).alias("b")) for which, c in enumerate(("edited_keys", "next_keys"))]))
    pairs = kept.select("bucket", "row", F.col("keys").alias("a"), other.alias("o")).select("bucket", (2 * F.col("row") + F.col("o.which")).alias("pair"), "a", "o.b")
    differ = [F.sum(F.when(F.pmod("pair", F.lit(2)) == k, F.col("found"))).alias(f"d{k}") for k in range(2)]
    found = stored(differing(pairs, ["bucket", "pair"]).groupBy("bucket", F.shiftright("pair", 1).alias("row")).agg(*differ), "found")

    def near(keys: str, d: str) -> Column:
        both = F.size("keys") + F.size(keys)
        apart = F.coalesce(d, F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart))

    return kept.join(found, ["bucket", "row"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(sketch(F.col("keys"))).alias("fingerprint"),
        written(sketch(F.col("edited_keys"))).alias("edited_fingerprint"),
        near("edited_keys", "d0").alias("near_edited"),
        near("next_keys", "d1").alias("near_next"),
    )
