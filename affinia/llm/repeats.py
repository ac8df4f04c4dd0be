"""Removal of repeated passages by suffix arrays, merged across shards.

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in the same one. Matches never cross documents and are judged on the input.

1. Anchors. In each string of LENGTH bytes, the GRAM bytes with the least hash are its anchor; equal
   strings have equal anchors. The strings with one anchor start next to each other; their bytes are
   the anchor's context. Every string belongs to exactly one context. Without this, each shard would have
   to send all its distinct strings, a hundred times its bytes. Long texts are read in slices.
2. Contexts that are equal as a whole (two 64-bit hashes) are repeats, but for the first one. This
   happens within a batch first, so that a passage of very many copies leaves few rows, then across
   batches, by the anchor's hash. An anchor with very many contexts in one batch sends one of them.
3. Anchors whose contexts differ may still share strings. Their first contexts are fetched from the
   texts and dealt to shards by anchor, those of an anchor with more than LOT contexts to several. A shard
   gets a suffix array by Larsson-Sadakane refinement (groups that are not yet single are sorted again
   by the rank that lies twice as far), and common prefixes by Kasai's method; suffixes that share
   LENGTH bytes are equal strings, and all but the first go.
4. Shards that share an anchor are merged: their distinct strings (two 64-bit hashes each, with the first
   place) are dealt by range, and each is looked up by binary search among those with an earlier place.

Texts are stored first with their row numbers, in parts by these: that is the one shuffle that they
cross, as the fetch and the final removal read them part by part.

Defined results: a null text is empty. Rows with a null id come last, and rows with equal ids in the
order in which they are read; each is a document of its own. Texts of fewer than LENGTH bytes stay
whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import bucketed, id_of, shuffle_parts, stored
from affinia.llm.hashing import U, buffers, chunks, mix, powers

LENGTH, GRAM = 100, 32
#: Bytes of contexts in one suffix array, and contexts of one anchor in it at most.
SHARD, LOT = 1 << 18, 1000
#: Strings that are looked at together in a long text.
SLICE = 1 << 20
#: An anchor with more contexts in a batch is known to have several.
OFTEN = 16
#: Bytes of texts whose contexts are sorted and sent together.
FLUSH = 1 << 22
_NO_ID = np.iinfo(np.int64).max
_BYTE = mix(np.arange(1001, 1257, dtype=U))
_PLACE = U((1 << 26) - 1)
#: What is known of a context: anchor, context hash, document, row, first start, further starts.
_KINDS = (("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("more", "u1"), ("several", "u1"))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, ctx, text, start, more of the contexts of some texts. text: which; start: in the text."""
    n, wide = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    order = np.full(-(-len(grams) // wide) * wide, ~U(0))
    order[: len(grams)] = grams & ~_PLACE | np.arange(len(grams), dtype=U)
    # The least of each window is that of the end of one block and the start of the next.
    blocks = order.reshape(-1, wide)
    starts = np.minimum.accumulate(blocks, axis=1).ravel()
    ends = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    least = (np.minimum(ends[:count], starts[wide - 1 : wide - 1 + count]) & _PLACE).astype(np.int64)
    inside = np.flatnonzero(np.arange(LENGTH, n + 1) <= np.repeat(at[1:], np.diff(at))[:count])
    if not len(inside):
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    least = least[inside]
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    s, anchor = inside[first], least[first]
    e = inside[np.concatenate((first[1:] - 1, [len(inside) - 1]))]
    more = e - s
    ctx = mix((sums[e + LENGTH] - sums[s]) * down[s] + mix((more << 8 | (anchor - s)).astype(U) + U(1)))
    text = np.searchsorted(at, s, "right") - 1
    return grams[anchor], ctx, text, s - at[text], more


def _in_order(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Contexts by anchor, context hash and place."""
    order = np.lexsort((c["start"], c["row"], c["doc"], c["ctx"], c["key"]))
    return {k: v[order] for k, v in c.items()}


def _packed(c: dict[str, np.ndarray]) -> bytes:
    return b"".join(c[k].astype(kind).tobytes() for k, kind in _KINDS)


def _unpacked(payloads: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in _KINDS)
    cols: dict[str, list[np.ndarray]] = {k: [] for k, _ in _KINDS}
    for p in payloads:
        n, at = len(p) // width, 0
        for k, kind in _KINDS:
            cols[k].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) if v else np.zeros(0, dict(_KINDS)[k]) for k, v in cols.items()}


def sliced(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(shift of the starts, anchors) of texts; a single long text comes in slices that overlap."""
    if len(at) > 2 or len(data) < SLICE + LENGTH:
        yield 0, anchors(data, at)
        return
    for low in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[low : low + SLICE + LENGTH - 1]
        yield low, anchors(part, np.array([0, len(part)]))


def _contexts(texts: DataFrame, parts: int) -> DataFrame:
    """part, kept, gone, more: the contexts of each batch, packed.

    gone are those equal to an earlier one of their batch. kept goes by anchor; of an anchor with more
    than OFTEN contexts only the first, marked as one of several, and the others are in more.
    """
    names = ["part", "kept", "gone", "more"]

    def sent(found: list[tuple]) -> pa.RecordBatch:
        cols = {k: np.concatenate(v) for (k, _), v in zip(_KINDS, zip(*found, strict=True), strict=False)}
        c = _in_order(cols | {"several": np.zeros(len(cols["key"]), np.uint8)})
        new_key = np.concatenate(([True], c["key"][1:] != c["key"][:-1]))[: len(c["key"])]
        again = np.zeros(len(c["key"]), bool)
        again[1:] = ~new_key[1:] & (c["ctx"][1:] == c["ctx"][:-1])
        group = np.cumsum(new_key) - 1
        often = (np.bincount(group, ~again) > OFTEN)[group] if len(group) else again
        c["several"] = often.astype(np.uint8)
        beside = often & ~new_key & ~again
        part = (c["key"] % U(parts)).astype(np.int64)
        out: tuple[list, list, list, list] = ([], [], [], [])
        order = np.argsort(part, kind="stable")
        order = order[~(again | beside)[order]]
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[bounds[p] : bounds[p + 1]]
            if len(mine):
                for col, v in zip(out, (p, _packed({k: v[mine] for k, v in c.items()}), b"", b""), strict=True):
                    col.append(v)
        spread = int(c["row"][0] + c["start"][0]) % parts if len(c["row"]) else 0  # any task can pass these on
        for col, v in zip(out, (spread, b"", _packed({k: v[again] for k, v in c.items()}), _packed({k: v[beside] for k, v in c.items()})), strict=True):
            col.append(v)
        return pa.record_batch([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        for batch in batches:
            rows = batch.column(0).to_numpy()
            docs = batch.column(1).fill_null(_NO_ID).to_numpy()
            for row, data, at in chunks(batch.column(2)):
                for shift, (key, ctx, text, start, more) in sliced(data, at):
                    found.append((key, ctx, docs[row + text], rows[row + text], start + shift, more))
                    size += min(len(data), SLICE)
                    if size >= FLUSH:
                        yield sent(found)
                        found, size = [], 0
        if found:
            yield sent(found)

    return texts.select("row", "doc_id", "text").mapInArrow(run, "part int, kept binary, gone binary, more binary")


_MARKED = "row long, start long, more int, key long"


def _marked(contexts: DataFrame, parts: int) -> DataFrame:
    """Contexts of repeated anchors: without key those that go, with key the first of several for one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[bytes] = []
        for batch in batches:
            kept += [x for x in batch.column(1).to_pylist() if x]
            yield rows(_unpacked(batch.column(2).to_pylist()), None)
            yield rows(_unpacked(batch.column(3).to_pylist()), "key")
        c = _in_order(_unpacked(kept))
        if len(c["key"]):
            new_key = np.concatenate(([True], c["key"][1:] != c["key"][:-1]))
            new_ctx = new_key | np.concatenate(([True], c["ctx"][1:] != c["ctx"][:-1]))
            group = np.cumsum(new_key) - 1
            several = (np.bincount(group, new_ctx) > 1) | (np.bincount(group, c["several"]) > 0)
            several = several[group]
            yield rows({k: v[~new_ctx] for k, v in c.items()}, None)
            yield rows({k: v[new_ctx & several] for k, v in c.items()}, "key")

    def rows(c: dict[str, np.ndarray], key: str | None) -> pa.RecordBatch:
        n = len(c["row"])
        keys = pa.array(c["key"].view(np.int64)) if key else pa.nulls(n, pa.int64())
        return pa.record_batch([pa.array(c["row"]), pa.array(c["start"].astype(np.int64)), pa.array(c["more"].astype(np.int32)), keys], ["row", "start", "more", "key"])

    return contexts.repartition(parts, "part").mapInArrow(run, _MARKED)


def suffix_order(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all strings of LENGTH bytes, sorted, and the common prefix of each with the one before.

    data: texts one after the other, each of LENGTH bytes at least; bounds: their starts, and the end.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(U)
    eight = np.zeros(n, U)
    for k in range(8):
        eight = eight << U(8) | padded[k : k + n]
    order = np.argsort(eight, kind="stable")
    new = np.concatenate(([True], eight[order][1:] != eight[order][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        outer, inner = rank[open_], rank[np.minimum(open_ + step, n - 1)]
        by = np.lexsort((inner, outer))
        open_, outer, inner = open_[by], outer[by], inner[by]
        i = np.arange(len(open_))
        new_outer = np.concatenate(([True], outer[1:] != outer[:-1]))
        new = new_outer | np.concatenate(([True], inner[1:] != inner[:-1]))
        rank[open_] = outer + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(new_outer, i, 0))
        depth += step
    many = np.diff(bounds) - LENGTH + 1
    starts = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    array = starts[np.argsort(rank[starts], kind="stable")]

    # Kasai: a text's next string shares at least one byte less than this one did, as long as the
    # string before it has a next one too. All texts take their steps together.
    place = np.full(n, -1, np.int64)
    place[array] = np.arange(len(array))
    common = np.zeros(len(array), np.int64)
    held = np.zeros(len(many), np.int64)
    wide = np.concatenate((eight, np.zeros(LENGTH + 8, U)))
    bytes_ = np.concatenate((data, np.zeros(LENGTH + 8, np.uint8)))
    for t in range(int(many.max())):
        of = np.flatnonzero(many > t)
        i = bounds[:-1][of] + t
        r = place[i]
        j = array[np.maximum(r - 1, 0)]
        h = held[of]
        live = np.flatnonzero(r > 0)
        h[r == 0] = 0
        while len(live):
            at = h[live]
            eight_same = (at + 8 <= LENGTH) & (wide[i[live] + at] == wide[j[live] + at])
            one_same = ~eight_same & (at < LENGTH) & (bytes_[i[live] + at] == bytes_[j[live] + at])
            h[live] = at + np.where(eight_same, 8, one_same)
            live = live[eight_same | one_same]
        common[r] = h
        next_too = (h > 0) & (h < LENGTH) & (place[np.minimum(j + 1, n - 1)] >= 0)
        held[of] = np.where(next_too, h - 1, 0)
    return array, common


def repeated_strings(contexts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each context, which of its strings of LENGTH bytes start earlier too; and where the distinct strings start first.

    contexts: one shard's, in the order of their places; the starts are those in the contexts put together.
    """
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
    text = b"".join(contexts)
    array, common = suffix_order(np.frombuffer(text, np.uint8), bounds)
    new = common < LENGTH
    least = np.minimum.reduceat(array, np.flatnonzero(new))
    flags = np.zeros(len(text), bool)
    flags[array[array != least[np.cumsum(new) - 1]]] = True
    return [flags[a : b - LENGTH + 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], least


def string_ids(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the strings of LENGTH bytes at some starts."""
    data = np.frombuffer(text, np.uint8)
    up, down = powers(len(data) + 1)
    out = []
    for salt in (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(mix(_BYTE ^ salt)[data] * up[: len(data)], out=sums[1:])
        out.append(mix((sums[starts + LENGTH] - sums[starts]) * down[starts]).view(np.int64))
    return out[0], out[1]


def _fetched(rows: DataFrame) -> DataFrame:
    """key, lot, doc, row, start, bytes of the contexts wanted. rows: row, doc_id, text, wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(2))
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for k, wants in enumerate(batch.column(3).to_pylist()):
                row, doc, base = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), int(at[k])
                for w in wants:
                    start = base + w["start"]
                    for col, v in zip(cols, (w["key"], w["lot"], _NO_ID if doc is None else doc, row, w["start"], data[start : start + w["more"] + LENGTH].tobytes()), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "lot", "doc", "row", "start", "bytes"])

    return rows.mapInArrow(run, "key long, lot int, doc long, row long, start long, bytes binary")


_SOLVED = "row long, start long, more int, doc long, a long, b long"


def _by_suffixes(fetched: DataFrame) -> DataFrame:
    """row, start, more of the runs of repeated strings within contexts that differ; all of a (key, lot) is in one task.

    Anchors with several lots (lot > 0) also give their distinct strings: row, start, doc and hashes a, b.
    """

    def solved(some: list[tuple], shared: bool) -> list[tuple]:
        some.sort(key=lambda x: x[:3])
        flags, least = repeated_strings([x[3] for x in some])
        out = []
        for (_, row, start, _), mine in zip(some, flags, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            out += [(row, start + int(a), int(b - a - 1), None, None, None) for a, b in edges.reshape(-1, 2)]
        if shared:
            bounds = np.cumsum([0] + [len(x[3]) for x in some])
            of = np.searchsorted(bounds, least, "right") - 1
            a, b = string_ids(b"".join(x[3] for x in some), least)
            for k, s, x, y in zip(of.tolist(), (least - bounds[of]).tolist(), a.tolist(), b.tolist(), strict=True):
                doc, row, start, _ = some[k]
                out.append((row, start + s, None, doc, x, y))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        size, last = 0, (None, 0)
        for batch in batches:
            out = []
            for key, lot, *place, bytes_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lot) != last and some and (size >= SHARD or lot or last[1]):
                    out += solved(some, last[1] > 0)
                    some, size = [], 0
                some.append((*place, bytes_))
                size, last = size + len(bytes_), (key, lot)
            yield made(out)
        yield made(solved(some, last[1] > 0) if some else [])

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "start", "more", "doc", "a", "b"])

    dealt = fetched.repartition("key", "lot").sortWithinPartitions("key", "lot")
    return dealt.select("key", "lot", "doc", "row", "start", "bytes").mapInArrow(run, _SOLVED)


def earlier_strings(a: np.ndarray, b: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which strings (hashes a, b) occur at an earlier place too. Looked up by binary search among the sorted first ones."""
    order = np.lexsort((*place[::-1], b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    firsts = order[new]
    pairs = np.zeros(len(a), [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = a, b
    return firsts[np.searchsorted(pairs[firsts], pairs)] != np.arange(len(a))


def _merged(strings: DataFrame) -> DataFrame:
    """row, start, more of the strings that another shard has at an earlier place; a range of hashes is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*([x.to_numpy() for x in b.columns] for b in batches if b.num_rows), strict=True)]
        if cols:
            row, start, doc, a, b = cols
            gone = earlier_strings(a, b, (doc, row, start))
            yield pa.record_batch([pa.array(row[gone]), pa.array(start[gone]), pa.array(np.zeros(int(gone.sum()), np.int32))], ["row", "start", "more"])

    return strings.select("row", "start", "doc", "a", "b").repartitionByRange("a", "b").mapInArrow(run, "row long, start long, more int")


def kept_ranges(size: int, starts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The removed runs, joined where they touch, and what is left; a row each, start and end."""
    if not len(starts):
        return np.zeros((0, 2), np.int64), np.array([[0, size]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + more + LENGTH)[order])
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    gone = np.stack((starts[first], ends[np.concatenate((first[1:] - 1, [len(ends) - 1]))]), axis=1)
    return gone, np.concatenate(([0], gone.ravel(), [size])).reshape(-1, 2)


_CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(rows: DataFrame, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            cols: tuple[list, ...] = ([], [], [], [])
            sizes = batch.column(2).value_lengths().fill_null(0).to_numpy()
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            spans = batch.column(2).flatten()
            starts, more = spans.field(0).to_numpy(), spans.field(1).to_numpy().astype(np.int64)
            for k in range(batch.num_rows):
                text = data[at[k] : at[k + 1]].tobytes()
                mine = slice(bounds[k], bounds[k + 1])
                gone, left = kept_ranges(len(text), starts[mine], more[mine])
                rest = b"".join(text[a:b] for a, b in left.tolist())
                made = hashlib.sha256(rest).hexdigest().encode() if digest else rest
                for col, v in zip(cols, (len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), made), strict=True):
                    col.append(v)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, _CLEANED)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of each row of docs (doc_id, text).

    kept: the bytes that are left, or with digest their SHA-256 in hexadecimal, as text in UTF-8.
    """
    parts = max(shuffle_parts(docs.sparkSession), 2 * docs.rdd.getNumPartitions())
    texts = docs.select(F.monotonically_increasing_id().alias("row"), id_of(docs), F.coalesce("text", F.lit("")).alias("text"))
    texts = bucketed(texts, "texts", "row", parts)
    marked = stored(_marked(_contexts(texts, parts), parts), "marked")
    differ = marked.where("key IS NOT NULL")
    crowded = differ.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOT).select("key", F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    lot = F.when(F.col("lots").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("row", "start"), F.col("lots"))).cast("int")
    wants = differ.join(stored(crowded, "crowded"), "key", "left").groupBy("row").agg(F.collect_list(F.struct("start", "more", "key", lot.alias("lot"))).alias("wants"))
    solved = stored(_by_suffixes(_fetched(texts.join(wants, "row").select("row", "doc_id", "text", "wants"))), "solved")
    gone = marked.where("key IS NULL").select("row", "start", "more").unionByName(solved.where("more IS NOT NULL").select("row", "start", "more")).unionByName(_merged(solved.where("more IS NULL")))
    spans = gone.groupBy("row").agg(F.collect_list(F.struct("start", "more")).alias("spans"))
    return _removed(texts.join(spans, "row", "left"), digest)
