"""Ranked lexical search: the best documents of each item, by sort-based accumulation.

The items are the stated query set. They are dealt into blocks of about BLOCK terms; for each block every
document is read once.

* The words of a document that some item has are its postings (term, occurrences); they are stored, and give
  document counts. A document's words that no item has only count for its length.
* In a task, the postings of some documents are spread over the items of their terms: arrays of item, document
  and impact. Item and document are packed into one key, the keys are put in order by radix sort (digits
  of 16 bits), and the impacts of each key are summed by reduceat.
* Each task keeps the best rows of each item. These are dealt by range of item and score, so that an item
  with many of them is in several tasks; heaps select the best of each range, and a window ranks what is left.

Weights and scores are whole numbers: see `weight`, `penalty` and `impact`.

Defined results: a term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
A null or empty text has no term; a document without terms isn't counted or found, an item without terms
gives no row. Each row is a document of its own, also if ids repeat; documents with a null id come last
among equal scores. Items that share an id are ranked each for itself. Extra columns are ignored. Empty
tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.common import id_of, shuffle_parts, stored
from affinia.llm.hashing import LOWER, chunks
from affinia.llm.tokens import words

#: Documents of each item.
BEST = 50
#: Terms of the items of one block at most, each counted once an item; an item with more is a block of its own.
BLOCK = 1 << 20
#: Impacts that are sorted at once; a document with more is sorted alone.
IMPACTS = 1 << 20

#: Letters, digits and the bytes of characters beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True


def weight(documents: int, holding: int) -> int:
    """A term's weight, from the number of documents and that of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def penalty(length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """50 for no length, and 50 more for each mean length."""
    return 100 - 50 + (50 * length * documents) // max(total, 1)


def impact(weights: np.ndarray, times: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score."""
    return weights * ((1000000000 * times) // (1000 * times + 20 * penalties))


def _terms(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The terms (bytes) of some texts, and each text's first (with the count at the end)."""
    for _, data, at in chunks(column):
        yield words(LOWER[data], INSIDE[data], at)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, terms (distinct) of each item that has terms, with a number for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for found, first in _terms(batch.column(1)):
                lists += [found[a:b].unique().to_pylist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])

    found = items.select(F.col(id_col).cast("long").alias("item_id"), text_col).mapInArrow(run, "item_id long, terms array<binary>")
    return stored(found.where(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id()), "items")


def blocks(items: DataFrame, most: int = BLOCK) -> list[DataFrame]:
    """The items in parts whose terms are at most so many, or that are one item."""
    n = 1
    while True:
        part = F.pmod(F.xxhash64("row"), F.lit(n))
        sizes = items.groupBy(part.alias("part")).agg(F.sum(F.size("terms")).alias("terms"), F.count(F.lit(1)).alias("items"))
        if sizes.where((F.col("terms") > most) & (F.col("items") > 1)).isEmpty():
            full = sorted(r["part"] for r in sizes.collect())  # a row for each block
            return [items.where(part == k) for k in full or [0]]
        n *= 2


@dataclass
class Queries:
    """The items of a block: their terms in order, and for each term the items that have it."""

    ids: np.ndarray
    null: np.ndarray
    terms: pa.Array
    edges: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, block: DataFrame) -> Queries:
        rows = sorted(block.collect(), key=lambda r: r["row"])  # a block: BLOCK terms, or one item
        flat = pa.array([bytes(t) for r in rows for t in r["terms"]], pa.large_binary())
        terms = flat.unique()
        of = pc.index_in(flat, terms).to_numpy(zero_copy_only=False)
        item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(terms) + 1))
        ids = np.array([r["item_id"] or 0 for r in rows], np.int64)
        return cls(ids, np.array([r["item_id"] is None for r in rows], bool), terms, edges, item[order])


def postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (terms with repeats), terms, times: the terms of the block that a document holds, by number."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.terms)  # bounded: a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            row = 0
            for found, first in _terms(batch.column(1)):
                coded = found.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                number = number[coded.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
                size = np.diff(first)
                of = np.repeat(np.arange(len(size)), size)
                hit = number >= 0
                packed, times = np.unique(of[hit] * max(len(known), 1) + number[hit], return_counts=True)
                lists = np.searchsorted(packed // max(len(known), 1), np.arange(len(size) + 1))
                lists = pa.array(lists, pa.int32())
                columns = [batch.column(0).slice(row, len(size)), pa.array(size), pa.ListArray.from_arrays(lists, pa.array((packed % max(len(known), 1)).astype(np.int32)))]
                yield pa.record_batch([*columns, pa.ListArray.from_arrays(lists, pa.array(times))], ["doc_id", "n", "terms", "times"])
                row += len(size)

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>").where("n > 0")


def radix_order(keys: np.ndarray, below: int) -> np.ndarray:
    """The order that sorts keys (0 to below): a stable pass for each 16 bits, from the lowest up."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while max(below, 0) >> shift:
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, added: np.ndarray, n_docs: int, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score): the sum of what was added for each item and document."""
    keys = item * n_docs + doc
    order = radix_order(keys, n_items * n_docs - 1)
    keys, added = keys[order], added[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(starts):
        return keys, keys, added
    return keys[starts] // n_docs, keys[starts] % n_docs, np.add.reduceat(added, starts)


class Best:
    """The best rows (item, score, doc_id, null) of each item so far."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.least = np.zeros(n_items, np.int64)
        self.rows = [np.zeros((4, 0), np.int64)]
        self.size, self.most = 0, max(1 << 18, 4 * best * n_items)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        """Takes in what may still be among the best: more than nothing, and at least the last of its item's best."""
        good = np.flatnonzero((score > 0) & (score >= self.least[item]))
        self.rows.append(np.stack((item[good], score[good], doc_id[good], null[good].astype(np.int64))))
        self.size += len(good)
        if self.size > self.most:
            self.prune()

    def prune(self) -> np.ndarray:
        rows = np.concatenate(self.rows, axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        place = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(np.append(starts, rows.shape[1])))
        last = place == self.best - 1
        self.least[rows[0][last]] = rows[1][last]
        rows = rows[:, place < self.best]
        self.rows, self.size = [rows], rows.shape[1]
        return rows


def _scored(found: DataFrame, queries: Queries, weights: np.ndarray, documents: int, total: int, best: int) -> DataFrame:
    """item, score, doc_id: each task's best rows of each item."""
    sent = found.sparkSession.sparkContext.broadcast((queries.edges, queries.items, weights))  # bounded: a block's terms
    n_items = len(queries.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, items, weights = sent.value
        top = Best(n_items, best)
        per = np.diff(edges)
        some = 65536 // max(1, min(n_items, 65536))
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            at = batch.column(2).offsets.to_numpy()
            terms, times = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            of = np.repeat(np.arange(len(ids)), np.diff(at))
            terms, times = terms[at[0] : at[-1]], times[at[0] : at[-1]]
            at = at - at[0]
            added = impact(weights[terms], times, penalty(batch.column(1).to_numpy(), documents, total)[of])
            spread = np.concatenate(([0], np.cumsum(per[terms])))
            a = 0
            while a < len(ids):
                b = max(a + 1, min(a + some, int(np.searchsorted(spread[at], spread[at[a]] + IMPACTS, "right")) - 1))
                own = slice(at[a], at[b])
                n = per[terms[own]]
                item = items[np.arange(n.sum()) + np.repeat(edges[terms[own]] - np.concatenate(([0], np.cumsum(n)[:-1])), n)] if n.sum() else np.zeros(0, np.int64)
                item, doc, score = accumulated(item, np.repeat(of[own] - a, n), np.repeat(added[own], n), b - a, n_items)
                top.add(item, score, ids[a + doc], null[a + doc])
                a = b
        rows = top.prune()
        yield pa.record_batch([pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2], mask=rows[3] == 1)], ["item", "score", "doc_id"])

    return found.mapInArrow(run, "item int, score long, doc_id long")


def _selected(scored: DataFrame, best: int) -> DataFrame:
    """The best rows of each item in each range, from a heap for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            item, score, doc_id = (c.to_pylist() for c in batch.columns)
            for i, s, d in zip(item, score, doc_id, strict=True):
                heap, row = heaps.setdefault(i, []), (s, d is not None, -(d or 0))
                if len(heap) < best:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
        rows = [(i, s, -d if known else None) for i, heap in heaps.items() for s, known, d in heap]
        item, score, doc_id = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc_id, pa.int64())], ["item", "score", "doc_id"])

    spark = scored.sparkSession
    dealt = scored.repartitionByRange(shuffle_parts(spark), "item", F.desc("score"), F.asc_nulls_last("doc_id"))
    return dealt.mapInArrow(run, "item int, score long, doc_id long")


def _of_block(docs: DataFrame, queries: Queries, best: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items of one block."""
    spark = docs.sparkSession
    found = stored(postings(docs, queries), "postings")
    counts = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = counts["documents"], counts["total"] or 0
    held = np.zeros(len(queries.terms), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a block's terms at most
        held[r["term"]] = r["count"]
    weights = np.array([weight(documents, n) for n in held.tolist()], np.int64)
    top = _selected(stored(_scored(found, queries, weights, documents, total, best), "scored"), best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = [(k, None if null else i) for k, (i, null) in enumerate(zip(queries.ids.tolist(), queries.null.tolist(), strict=True))]
    ids = F.broadcast(spark.createDataFrame(names, "item int, item_id long"))  # a block's items
    return ranks.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best documents of each item, with a score above 0."""
    slim = docs.select(id_of(docs), "text")
    found = [_of_block(slim, Queries.of(part), best) for part in blocks(item_terms(items, id_col, text_col), most)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
