"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector w for all grades and ordered thresholds
t_0 < t_1 < ...  x marks which hashed features a text has: its words, their first and last bytes, and
how often a word follows itself. Weights are at most 0 (each step is projected): a feature can only speak
against a text, so that neither its length nor its topic speaks for it. Held out, this keeps more clean
documents and fewer toxic ones than free weights do (README). A row's score gives the expected grade and the tail probability
P(grade >= selected grade), by which rows are selected.

The grade of a labelled document is the number of its two ratings that are good: 2 for good quality
and not toxic, 1 for one flaw, 0 for both.

Fitting takes at most SAMPLE labelled rows, those with the smallest hashes of their ids; their
features (not texts) meet in the driver. Scoring reads every row, whole texts, in Arrow tasks.

Defined results: a null or empty text has no features and scores by the thresholds alone; labels with
a null id, quality or toxic, or without a document, are not used; of repeated labels each counts.
Without any labelled row, all grades are equally likely and nothing is rejected. Extra columns pass
through `select` unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from affinia.llm.hashing import LOWER, VALUE, U, chunks, mix, powers, word_bounds

#: At most so many labelled rows are fitted on.
SAMPLE = 12_000
BITS = 18
GRADES = 3
EPOCHS = 80
RATE = 0.1
DECAY = 5e-3
#: Features in fewer fitted rows have no weight.
MIN_ROWS = 3
#: A row is kept when P(grade >= 2) is at least this.
LEAST = 0.7
#: Bytes of a word's start and end that are features of their own.
HEAD, TAIL = 6, 2


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each text."""
    for _, data, at in chunks(column):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, at)
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE[data] * up[: len(data)], out=sums[1:])
        kinds = []
        for kind, (a, b) in enumerate(((starts, ends), (starts, np.minimum(ends, starts + HEAD)), (np.maximum(starts, ends - TAIL), ends))):
            kinds.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93) + U(kind)) >> U(64 - BITS))
        again = np.zeros(len(starts), bool)
        again[1:] = kinds[0][1:] == kinds[0][:-1]
        again[first[:-1][first[:-1] < len(starts)]] = False
        repeats = np.concatenate(([0], np.cumsum(again)))
        found = np.stack(kinds, axis=1).astype(np.int32)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = int(repeats[b] - repeats[a])
            levels = [k for k in range(8) if n >= 1 << k] + [8 + k for k in range(1, 8) if n * 10 >= k * (b - a) > 0]
            one = np.sort(np.concatenate((found[a:b].ravel(), np.array(levels, np.int32))))
            yield one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Maximum likelihood by full-batch AdaGrad; thresholds stay ordered as a first one and positive steps."""
    weights, ks = np.zeros(1 << BITS, np.float64), np.arange(GRADES - 1)
    if not len(rows):
        return Model(weights, np.zeros(GRADES - 1))
    seen = np.bincount(grades, minlength=GRADES) + 0.5
    above = np.cumsum(seen[::-1])[::-1][1:] / seen.sum()
    t = np.sort(-np.log(above / (1 - above)))
    first, steps = t[0], np.log(np.maximum(np.diff(t), 1e-3))
    common = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= MIN_ROWS
    kept = [common[r] for r in rows]
    sizes, count = np.array([int(k.sum()) for k in kept]), len(rows)
    ids = np.concatenate([r[k] for r, k in zip(rows, kept, strict=True)]).astype(np.int64)
    del rows, kept
    at = np.concatenate(([0], np.cumsum(sizes)))
    sums_w, sums_t = np.full_like(weights, 1e-6), np.full(GRADES - 1, 1e-6)
    for _ in range(epochs):
        totals = np.concatenate(([0.0], np.cumsum(weights[ids])))
        scores = totals[at[1:]] - totals[at[:-1]]
        del totals
        t = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        tail = np.hstack((np.ones((count, 1)), Model(weights, t).tails(scores), np.zeros((count, 1))))
        slope = tail * (1 - tail)
        i = np.arange(count)
        p = np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-9)
        by_score = -(slope[i, grades] - slope[i, grades + 1]) / p
        by_t = np.array([((grades == k + 1) * slope[i, k + 1] / p - (grades == k) * slope[i, k + 1] / p).sum() for k in ks])
        grad = np.bincount(ids, np.repeat(by_score, sizes), len(weights)) / count + decay * weights
        by_step = np.array([by_t[k + 1 :].sum() * np.exp(steps[k]) for k in range(GRADES - 2)])
        grad_t = np.concatenate(([by_t.sum()], by_step)) / count
        sums_w += grad**2
        sums_t += grad_t**2
        weights = np.minimum(weights - rate * grad / np.sqrt(sums_w), 0)
        move = rate * grad_t / np.sqrt(sums_t)
        first, steps = first - move[0], steps - move[1:]
    return Model(weights, first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted on at most sample labelled rows."""
    grade = (F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna()
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The gaps between the sorted numbers pack well; they are all that the driver holds.
            found = [zlib.compress(np.diff(f, prepend=np.int32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for f in features(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.binary())], ["doc_id", "grade", "found"])

    rows = texts.select("doc_id", "grade", "text").mapInArrow(extract, "doc_id long, grade int, found binary").collect()
    rows = sorted((r["doc_id"], r["grade"], bytes(r["found"])) for r in rows)
    gaps = (np.frombuffer(zlib.decompress(found), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for _, _, found in rows)
    grades = np.array([g for _, g, _ in rows], np.int64)
    return fit([np.cumsum(g, dtype=np.int64).astype(np.int32) for g in gaps], grades)


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """docs with expected_grade, p_good (P(grade >= 2)) and kept; the names must be free in docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2**BITS numbers, whatever the input
    names = docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        for batch in batches:
            scores = np.array([weights[f].sum(dtype=np.float64) for f in features(batch.column(names.index("text")))])
            tails = Model(weights, thresholds).tails(scores) if len(scores) else np.zeros((0, GRADES - 1))
            more = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            yield pa.record_batch([*batch.columns, *more], [*names, "expected_grade", "p_good", "kept"])

    schema = StructType(list(docs.schema.fields))
    for name, kind in (("expected_grade", "double"), ("p_good", "double"), ("kept", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(rate, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, p_good, kept of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(slim, train(docs, labels, sample), least).drop("text")


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns."""
    names = docs.columns
    model = train(docs, labels, sample)
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names)])
    kept = score(inner, model, least).where("kept").drop("expected_grade", "p_good", "kept")
    return kept.toDF(*names)
