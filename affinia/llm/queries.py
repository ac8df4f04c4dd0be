"""The registered queries of this subpackage: opN_<name> over the whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.llm.common import read


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.jaccard import join_components

    return join_components(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.mixing import measured, rates

    return rates(measured(read(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.repeats import remove_repeats

    done = remove_repeats(read(spark, sf_dir, "documents"), digest=True)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.warc import archived

    return archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.personal import find

    found = find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def model_bytes() -> bytes:
    """The tokenizer's file; AFFINIA_PIECES names another one."""
    path = os.environ.get("AFFINIA_PIECES")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.pieces import digests

    return digests(read(spark, sf_dir, "documents"), model_bytes())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.language import identify

    return identify(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.simhash import near_components

    found = near_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.periods import collapse

    found = collapse(with_repeats(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    one = found.select("doc_id", "runs", "collapsed", longest.alias("x"))
    return one.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("x.before")).alias("start"),
        F.col("x.length").alias("length"),
        (-F.col("x.less")).alias("period"),
        F.expr("(1000 * x.length) div -x.less").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one document of ten, by the hash of its id, the words from one on repeat a first stretch of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    found = F.when(chosen, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = docs.select("doc_id", "text", found.alias("found"), F.floor(h / 10).alias("g"))
    n = F.size("found")
    rows = rows.select("doc_id", "text", "found", n.alias("n"), "g", F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    # floor((n - a) / (3 + g % 8)) is in whole numbers; at most ten stretches of that length and one word fill the rest.
    rows = rows.select("doc_id", "text", "found", "n", "a", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)").alias("p"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("found", F.col("a") + 1, F.col("p")), 10)), F.lit(1), F.col("n") - F.col("a"))
    repeated = F.array_join(F.concat(F.slice("found", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinia.llm.ranked import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_repeats": op4_repeats,
    "op5_warc": op5_warc,
    "op6_personal": op6_personal,
    "op7_pieces": op7_pieces,
    "op8_fingerprints": op8_fingerprints,
    "op9_language": op9_language,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_simhash": op11_simhash,
    "op12_periods": op12_periods,
    "op13_search": op13_search,
}
