"""The pipeline against a brute-force version of its stages, and the registered queries."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from affinia.llm.common import read
from affinia.llm.queries import QUERIES, model_bytes

from .test_exact_mixing import brute as brute_exact
from .test_jaccard import brute as brute_near

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def test_stages(spark):
    import sentencepiece

    from affinia.llm.mixing import measured, rates
    from affinia.llm.quality import classify

    docs = read(spark, SF, "documents")
    kept = {r.doc_id for r in classify(docs, read(spark, SF, "labels")).collect() if r.kept}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    one = {x[0] for x in brute_exact([(i, r.text) for i, r in rows.items()]) if x[3]}
    two = {i for i, (_, c) in brute_near([(i, rows[i].text) for i in one], 5, 80).items() if i == c}
    rest = spark.createDataFrame([rows[i] for i in sorted(two)], docs.schema)
    copies = {r.doc_id: r.copies for r in rates(measured(rest)).collect() if r.copies}
    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    want = Counter()
    for i, n in copies.items():
        ids = sp.encode(rows[i].text or "") + [sp.eos_id()]
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] = n
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_keep_the_columns(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_repeated_and_null_ids_lose_no_text(spark, docs_of):
    rows = [(3, "a b c"), (5, "a b c"), (5, "unique other text"), (None, "a b c"), (None, "lone"), (5, "a b c"), (7, None), (8, " ")]
    docs = docs_of(rows)
    kept = corpus_pipeline.distinct_texts(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "a b c"), (5, "unique other text"), (None, "lone"), (8, " ")], key=str)
    long_ = " ".join(f"w{k}" for k in range(60))
    rows = [(4, long_), (2, long_ + " end"), (2, "another text of the same id here"), (None, long_), (6, long_), (7, None), (8, "")]
    kept = corpus_pipeline.distinct_shingles(spark, docs_of(rows), SF)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, long_ + " end"), (2, "another text of the same id here"), (7, None), (8, "")], key=str)


def test_empty_tables(spark, docs_of):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), SF).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_each(spark, name):
    table = "pages" if name.startswith("op5") else "documents"
    assert QUERIES[name](spark, SF).count() == read(spark, SF, table).count()


def test_entry_lists_them():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
