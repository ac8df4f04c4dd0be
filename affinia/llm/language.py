"""Language identification by nearest centroids.

A text is a unit vector of TF-IDF weights over hashed byte trigrams of its letters. Each language has
several centroids, found by spherical k-means; the language of the nearest one (by cosine) is
predicted. A text further from every centroid than nearly all rows that were learned from is marked
as rejected, beside its nearest language.

Document frequencies cover all rows that may be learned from. Centroids are fitted in the driver on at
most PER_LANG rows a language, those with the smallest hashes of their ids; only their vectors meet.
Prediction reads every row, whole texts, in Arrow tasks.

Defined results: a null text, or one without a letter, is `und` with score 0 and is rejected. Rows with
a null language are predicted but not learned from. With nothing to learn from, all is `und`. Repeated
rows get equal predictions. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.common import stored
from affinia.llm.hashing import LOWER, U, chunks, mix

BITS = 13
DIM = 1 << BITS
#: At most so many rows of a language are clustered, into so many centroids.
PER_LANG, CENTROIDS, ROUNDS = 400, 4, 8
#: The share of fitted rows that would be rejected.
REJECT = 0.002
#: Bytes and rows that are counted together: a row's counts are DIM numbers.
CHUNK, ROWS = 1 << 18, 128

#: Letters and the bytes of other scripts stay; anything else is a gap.
_KEPT = LOWER.copy()
_KEPT[:65] = _KEPT[91:97] = _KEPT[123:128] = 32


def counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Trigram counts, a row for each text, some texts at once."""
    for _, data, at in chunks(column, CHUNK, ROWS):
        c = np.concatenate((_KEPT[data], [32, 32])).astype(U)
        codes = (mix(c[:-2] << U(16) | c[1:-1] << U(8) | c[2:]) >> U(64 - BITS)).astype(np.int64)
        inside = np.maximum(np.diff(at) - 2, 0)
        of = np.repeat(np.arange(len(inside)), inside)
        where = np.arange(len(of)) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(inside)[:-1])), inside)
        yield np.bincount(of * DIM + codes[where], minlength=len(inside) * DIM).reshape(len(inside), DIM)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vectors(self, found: np.ndarray) -> np.ndarray:
        v = np.log1p(found, dtype=np.float32) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts with rows that are far apart."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        best = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[best == j].sum(axis=0) if (best == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def train(docs: DataFrame) -> Model:
    """Learned from docs (doc_id, text, lang): all rows give document frequencies, a bounded sample the centroids."""
    usable = docs.where(has_letter(F.col("text")) & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for found in counts(batch.column(0)):
                df[:DIM] += (found > 0).sum(axis=0)
                n += len(found)
        df[DIM] = n
        yield pa.record_batch([pa.array(np.arange(DIM + 1)), pa.array(df)], ["dim", "n"])

    sums = usable.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    df = np.zeros(DIM + 1)
    for row in sums.collect():  # DIM + 1 rows, whatever the input
        df[row["dim"]] = row["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])).astype(np.float32) + 1

    # About three times the rows that are needed have low hashes; only those are ranked. The table of
    # languages is stored, so that Spark knows its size before it plans the join.
    sizes = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "languages")
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("__n") < F.lit(float(3 * PER_LANG << 20))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id", "text")
    sample = usable.join(sizes, "lang").where(low).withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= PER_LANG)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for found in counts(batch.column("text")) for r in found]
            kept = [np.flatnonzero(r) for r in rows]
            dims = pa.array([k.astype(np.int32).tobytes() for k in kept], pa.binary())
            found = pa.array([r[k].astype(np.int32).tobytes() for r, k in zip(rows, kept, strict=True)], pa.binary())
            yield pa.record_batch([batch.column("lang"), batch.column("doc_id"), dims, found], ["lang", "doc_id", "dims", "found"])

    rows = sample.select("lang", "doc_id", "text").mapInArrow(sparse, "lang string, doc_id long, dims binary, found binary").collect()
    model = Model(idf, np.zeros((0, DIM), np.float32), [], np.zeros(0))
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, bytes(r["dims"]))):
        by_lang.setdefault(r["lang"], []).append(r)
    centres, least = [], []
    for lang, some in by_lang.items():
        dense = np.zeros((len(some), DIM), np.float32)
        for i, r in enumerate(some):
            dense[i, np.frombuffer(r["dims"], np.int32)] = np.frombuffer(r["found"], np.int32)
        vectors = model.vectors(dense)
        own = _cluster(vectors, CENTROIDS)
        centres.append(own)
        least += [float(np.quantile((vectors @ own.T).max(axis=1), REJECT))] * len(own)
        model.langs += [lang] * len(own)
    if centres:
        model.centroids, model.least = np.concatenate(centres), np.array(least)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # centroids: DIM numbers for each of a few per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            best, near = [], []
            for found in counts(batch.column(1)):
                cos = m.vectors(found) @ m.centroids.T if len(m.langs) else np.zeros((len(found), 1), np.float32)
                best.append(cos.argmax(axis=1))
                near.append(cos.max(axis=1))
            at = np.concatenate(best) if best else np.zeros(0, np.int64)
            score = np.clip(np.concatenate(near), 0, 1).astype(np.float64) if near else np.zeros(0)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(len(m.langs))
            lang = [m.langs[i] if x else "und" for i, x in zip(at, letters, strict=True)]
            out = ~letters | (score < m.least[at] if len(m.langs) else True)
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(out)], ["doc_id", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter(F.col("text")).alias("letters"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(slim.where(~held_out(F.col("doc_id"))))
    return predict(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
