"""Near-duplicates by SimHash fingerprints, found with fuzzy keys of the binary Golay code.

A fingerprint has a bit for each bit of the shingles' hashes: it is 1 if set in over half of them.
Fingerprints link when at most BITS_APART bits differ.

* Pigeonhole: the 64 bits are three segments. Two errors leave one segment whole, and of its two neighbours
  round the ring the next one has one error at most (if it had two, the third would be whole, and its next
  is the first). So a key is a whole segment with a codeword near the next segment: three kinds of keys.
* Fuzzy keys: the perfect Golay code [23, 12, 7] puts each word of 23 bits within three bits of one codeword. A
  segment has its own codeword, and those of its one-bit neighbours that have smaller numbers: of two segments
  one bit apart, both have the smaller of their codewords.
* Join and verify: distinct fingerprints meet by key and are compared. A key with more than GROUP
  fingerprints isn't compared in pairs: its members meet at all fingerprints at most one bit from them, where
  two of them meet exactly when at most two bits differ, and no more than 65 can.

Components are those of distinct fingerprints, so that copies cost one row.

Defined results: A-Z are lower-cased, words are runs of other than white space, shingles keep their
repeats; a text with fewer words than a shingle has its whole sequence as one. A text that is null or has no
words has fingerprint zero and links like any other. Rows that share an id are rows of their own. A row with
a null id counts for links; its component is the smallest id in it, or null if there is none. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import id_of, stored
from affinia.llm.graphs import components
from affinia.llm.hashing import LOWER, WHITE, U, chunks
from affinia.llm.tokens import spaced, spans

WIDTH, SEED, BITS_APART = 3, 42, 2
#: Bits of the three segments.
SEGMENTS = (22, 21, 21)
#: Fingerprints of one key that are compared in pairs at most.
GROUP = 64
#: Shingles whose bits are counted at once.
SLICE = 1 << 15

#: The Golay code: length, message bits, errors it corrects, and its generator
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
LENGTH, MESSAGE, ERRORS, GENERATOR = 23, 12, 3, 0b110001110101


def _hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), U, len(starts))


def _majority(text: bytes, starts: np.ndarray, ends: np.ndarray) -> int:
    """The fingerprint of the shingles from starts to ends."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), SLICE):
        h = _hashes(text, starts[a : a + SLICE], ends[a : a + SLICE])
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(U)[0])


def simhashes(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text."""
    out = []
    for _, data, at in chunks(column):
        data, inside = LOWER[data], ~WHITE[data]
        starts, ends, first = spans(inside, at)
        text, where = spaced(data, inside, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            size = min(width, b - a)
            out.append(_majority(text, where[a : b - size + 1], where[a + size : b + 1] - 1) if size else 0)
    return np.array(out, U)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(simhashes(batch.column(1), width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(id_of(docs), "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each bit, and the errors behind each syndrome: a rule gives both."""
    bits = []
    for k in range(LENGTH):
        rest = 1 << k
        for high in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - (LENGTH - MESSAGE))
        bits.append(rest)
    errors = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
    for n in range(1, ERRORS + 1):
        for some in combinations(range(LENGTH), n):
            errors[np.bitwise_xor.reduce([bits[k] for k in some])] = sum(1 << k for k in some)
    return np.array(bits, np.int64), errors


def codewords(segment: np.ndarray) -> np.ndarray:
    """The number of the one codeword within three bits of each word of 23 bits: its message bits."""
    bits, errors = _code()
    syndrome = np.zeros(len(segment), np.int64)
    for k in range(LENGTH):
        syndrome ^= (segment >> k & 1) * bits[k]
    return (segment ^ errors[syndrome]) >> (LENGTH - MESSAGE)


def near_codewords(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword): each segment's own codeword, and the smaller ones of its neighbours one bit away."""
    own = codewords(segment)
    rows, found = [np.arange(len(segment))], [own]
    for k in range(width):
        other = codewords(segment ^ (1 << k))
        less = np.flatnonzero(other < own)
        rows.append(less)
        found.append(other[less])
    both = np.unique(np.concatenate(rows) << MESSAGE | np.concatenate(found))
    return both >> MESSAGE, both & ((1 << MESSAGE) - 1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): any two fingerprints with at most two differing bits have a key in common."""
    starts = np.concatenate(([0], np.cumsum(SEGMENTS)[:-1]))
    parts = [(fps >> U(s) & U((1 << w) - 1)).astype(np.int64) for s, w in zip(starts.tolist(), SEGMENTS, strict=True)]
    rows, keys = [], []
    for k in range(3):
        row, code = near_codewords(parts[(k + 1) % 3], SEGMENTS[(k + 1) % 3])
        rows.append(row)
        keys.append((k << max(SEGMENTS) | parts[k][row]) << MESSAGE | code)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    """key, fp of the fuzzy keys of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, key = fuzzy_keys(fp.view(U))
            yield pa.record_batch([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _hubs(fps: DataFrame) -> DataFrame:
    """at, fp: each fingerprint at itself and at its 64 neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate(([U(0)], U(1) << np.arange(64, dtype=U)))
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE // 64):
                fp = batch.column(0).to_numpy()[a : a + SLICE // 64]
                at = (fp.view(U)[:, None] ^ masks).ravel().view(np.int64)
                yield pa.record_batch([pa.array(at), pa.array(np.repeat(fp, len(masks)))], ["at", "fp"])

    return fps.select("fp").mapInArrow(run, "at long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """u, v: links that connect all distinct fingerprints with at most two differing bits."""
    keyed = stored(_keyed(fps), "fuzzy")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("key").alias("__key"), "n")
    met = stored(keyed.withColumn("__key", F.xxhash64("key")).join(shared, "__key").select("key", "fp", "n"), "met")

    groups = met.where(F.col("n") <= GROUP).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = groups.select(F.explode("fps").alias("u"), "fps").select(
        "u", F.explode(F.filter("fps", lambda v: (F.col("u") < v) & (F.bit_count(F.col("u").bitwiseXOR(v)) <= BITS_APART))).alias("v")
    )
    crowded = stored(met.where(F.col("n") > GROUP).select("fp").distinct(), "crowded")
    at_hubs = _hubs(crowded).groupBy("at").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    through = at_hubs.select("u", F.explode("fps").alias("v")).where("u <> v")
    return near.unionByName(through).distinct()


def near_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (long), component_id of each row of docs (doc_id, text)."""
    rows = stored(fingerprints(docs, width), "simhashes")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    # xxhash64 of one long gives each another number: nodes spread at random, without a collision.
    edges = links(classes).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    groups = components(edges)
    linked = stored(classes.withColumn("node", F.xxhash64("fp")).join(groups, "node").select("fp", "first", "root"), "linked")
    firsts = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    of_linked = linked.join(firsts, "root").select("fp", "component_id")
    of_copies = classes.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    named = stored(of_linked.unionByName(of_copies).withColumn("named", F.lit(True)), "named")
    return rows.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
