"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.llm import (
    chat, decontamination, language_id, line_crf, mixing, packing, periodic, prefix_trie, recompression,
    simhash_trie, suffix_dedup, toxicity, warc,
)
from lossweave.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


COPIES = """first AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)"""


@query(
    "op1_warc",
    f"""WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), {COPIES}
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN first ON p.payload_digest = first.payload_digest AND payload_bytes >= 100""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.round_trip(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), match=400)
    size, left = F.octet_length(F.coalesce("text", F.lit(""))), F.octet_length("kept")
    return cut.select(
        "doc_id",
        size.cast("long").alias("n_bytes"),
        (size - left).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_line_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judged = line_crf.judge(docs, line_crf.fit(docs, read(spark, sf_dir, "labels")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", "content_share")


FIRST_WINDOWS = """WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
  (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, w, array_agg(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM w),
r AS (SELECT doc_id, i, w, CAST(len(win) = 20 AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS INTEGER) AS again FROM g),
c AS (SELECT doc_id, i, w, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, count(w) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op5_recompression", FIRST_WINDOWS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeats(read(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "passages")


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_perspectives", chat.perspectives_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.perspectives(read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return turned.withColumn("mask", F.array_join(spans, ","))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    named = language_id.identify(docs, language_id.fit(docs))
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_simhash_trie")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_distance=2)


@query("op11_mixing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op12_prefix_trie", prefix_trie.prefix_nodes_sql(100, 6))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read(spark, sf_dir, "conversations"), group=100, heads=6)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(periodic.planted(read(spark, sf_dir, "documents")), least_length=6, exponent=4)
    listed = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    lines = F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), "")
    best = periodic.greatest_run(F.col("runs"))
    found = found.select("doc_id", "runs", lines.alias("lines"), best.alias("best"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
