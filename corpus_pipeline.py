"""The corpus pipeline: from raw documents to packed training sequences.

Each stage calls one operator of ``lossweave.llm`` on all that the stage before it kept, and its result is
written as Parquet to the shared folder and read again as the next stage's documents. All but the last stage
return the columns of documents.

Defined results, beside those of the operators: rows without an id are kept by every stage but count as one
document in decontamination; near duplicates with the smallest id of their group stay, of repeated rows with
that id one; documents from which suffix-array deduplication took everything go, documents that were empty
before stay; a character of which a cut takes a byte goes as a whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lossweave.llm import decontamination, packing, simhash_trie, suffix_dedup, toxicity
from lossweave.llm.tables import pin, read

#: Bytes of a repeated passage: 99 of 100 stretches of 51 words are as long (median 316 bytes, 1st percentile 203).
PASSAGE = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scores reject go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=True).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    found = simhash_trie.near_duplicates(docs, shingle=3, max_distance=2)
    keep = pin(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count(), "kept-ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    chosen = rows.join(keep.select("doc_id").hint("shuffle_hash"), same, "left_semi")
    again = keep.where("count > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return chosen.select("row.*")
    # rows that share the kept id: the one with the smallest hash stays
    many = chosen.join(again, same, "left_semi").groupBy("row.doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    once = chosen.join(again, same, "left_anti")
    return once.unionByName(many.select("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte strings of PASSAGE bytes or more that occur more than once, all occurrences but the first are cut
    out of the texts, with the characters that they touch."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", row), match=PASSAGE, keep_first=True, whole_characters=True)
    touched = F.size("spans") > 0
    cut = cut.where(~touched | (F.octet_length("kept") > 0))
    text = F.when(touched, F.col("kept").cast("string")).otherwise(F.col("text"))
    length = F.when(touched, F.char_length(F.col("kept").cast("string")).cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": length}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences of 2048."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Fitted models, alignment and tokenizers have no SQL counterpart; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
