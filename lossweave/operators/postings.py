"""A stored keyword index: posting lists in slots of claims, searched by block-max pruning.

Claims are dealt into slots of ``slot_claims`` inside the tasks that read their counts; nothing is shuffled for it. A row
of the index is a slot: ids and lengths of its claims, and per bucket of terms the terms' postings (place of the claim in the slot,
frequency) and headers: number of postings, greatest frequency and least length, from which follows a bound
on the term's part of any score in the slot, whatever the mean length of the corpus. The sum of the bounds of a query's terms
bounds the score of every claim of a slot.

A search reads headers first. The best-bounded slots of each query are scored in full; their k-th best
score is a lower bound for the k-th best of all, so slots whose bound lies below it cannot matter, and only the
others are scored. Tasks hold a chunk of slots and a stored block of queries at a time and send their best hits per query;
neither headers, postings nor pairs of queries and slots are shuffled. No text and no token list is read.
Results equal those of ``keyword.bm25_candidates`` without filters (filters change the statistics of
the corpus, so they need the claims themselves).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossweave.functions.slots import FIELDS, HEADER, block_batches, buckets_of, deal_batches, first_batches, own_batches, score_first, score_slots
from lossweave.operators.keyword import K1, B, counted_claims, query_sizes, query_slot, query_terms, scaled, store_query_blocks, top_per_query
from lossweave.runtime import shared_dir, write_once

SLOT_CLAIMS = 256
BUCKETS = 16
FIRST_SLOTS = 4  # slots per query that give the first bound
_OWN_IDS = 65_536  # ids that a task looks for at a time
# A reader holds a row group at a time, whose lists are some times as large in memory. A writer must look at its size after
# few rows, as they are long.
_WRITER = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 2, "parquet.page.size.row.check.max": 2, "compression": "zstd"}
_KINDS = {"terms": "array<string>"}


def _schema(buckets: int, fields: tuple[str, ...] = FIELDS) -> str:
    of = ", ".join(f"{f}: {_KINDS.get(f, 'array<int>')}" for f in fields)
    return "slot long, ids array<string>, dls array<int>, " + ", ".join(f"b{k} struct<{of}>" for k in range(buckets))


def write_postings(claims: DataFrame, path: str, slot_claims: int = SLOT_CLAIMS, buckets: int = BUCKETS) -> None:
    """Write the index of claims (claim_id and document, or token columns) below ``path``. Ids are unique.

    Claims are counted once, inside the tasks that tokenize them (``counted_claims``). Tasks deal the stored counts out into slots;
    a word that stands in every claim is in all tasks, and in each as many times as it has slots."""

    def deal(batches):
        yield from deal_batches(batches, slot_claims, buckets, TaskContext.get().partitionId())

    counts = counted_claims(claims).select("claim_id", "dl", "terms", "tfs", "dls")
    dealt = counts.mapInArrow(deal, _schema(buckets))
    dealt.write.mode("overwrite").options(**_WRITER).parquet(path)


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.buckets)).parquet(self.path)

    def headers_by_slot(self) -> DataFrame:
        """The index without postings and claims, which are then not read."""
        parts = [F.struct(*[F.col(f"b{k}.{f}").alias(f) for f in HEADER]).alias(f"b{k}") for k in range(self.buckets)]
        return self.rows().select("slot", *parts)

    def _blocks(self, held: bool, terms: DataFrame | None) -> DataFrame:
        wanted, buckets = list(range(self.buckets)), self.buckets
        if terms is not None:

            def numbers(batches):
                for batch in batches:
                    yield batch.from_arrays([buckets_of(batch.column(0), buckets)], names=["b"])

            wanted = sorted(r.b for r in terms.select("term").where("term is not null").mapInArrow(numbers, "b long").distinct().collect())

        def blocks(batches):
            yield from block_batches(batches, wanted, held)

        fields = FIELDS if held else HEADER
        parts = [F.struct(*[F.col(f"b{k}.{f}").alias(f) for f in fields]).alias(f"b{k}") for k in wanted]
        rows = self.rows().select("slot", *(["ids", "dls"] if held else []), *parts)
        kept = "held array<struct<claim_id: string, tf: long, dl: int>>, " if held else ""
        return rows.mapInArrow(blocks, f"term string, slot long, count long, max_tf long, min_dl int, {kept}bucket int")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """Blocks of all terms, or those in the buckets of the wanted terms (at most ``buckets`` numbers are collected)."""
        return self._blocks(True, terms)

    def headers(self, terms: DataFrame | None = None) -> DataFrame:
        """``postings`` without the postings."""
        return self._blocks(False, terms)

    def slots(self) -> DataFrame:
        tokens = F.aggregate("dls", F.lit(0).cast("long"), lambda total, dl: total + dl)
        return self.rows().select("slot", F.size("dls").cast("long").alias("size"), tokens.alias("tokens"))

    def lengths(self) -> DataFrame:
        return self.rows().select("slot", F.explode(F.arrays_zip("ids", "dls")).alias("h")).select(F.col("h.ids").alias("claim_id"), "slot", F.col("h.dls").alias("dl"))

    def corpus_size(self) -> DataFrame:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return self.slots().agg(total("size").alias("n_docs"), total("tokens").alias("n_tokens"), F.count("*").alias("n_slots"))

    def document_frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) from the headers; ``terms`` tell the buckets to read."""
        return self.headers(terms).groupBy("term").agg(F.sum("count").alias("df"))


def _own_claims(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """(query_id, dl, docs, terms) of the stored claims that queries exclude."""
    sources = asked.where("exclude_claim_id is not null").select("query_id", F.col("exclude_claim_id").alias("claim_id")).distinct()
    ids = write_once(sources.select("claim_id").distinct(), "own-ids")
    parts, buckets = max(1, -(-ids.count() // _OWN_IDS)), index.buckets
    path = shared_dir(index.spark, "own-id-blocks")
    ids.withColumn("slot", F.pmod(F.xxhash64("claim_id"), F.lit(parts))).repartition(parts, "slot").write.partitionBy("slot").parquet(path)

    def own(batches):
        yield from own_batches(batches, path, parts, buckets)

    found = write_once(index.rows().mapInArrow(own, "claim_id string, dl int, terms array<string>"), "own-terms")
    return sources.join(found, "claim_id").select("query_id", "dl", F.lit(1).cast("long").alias("docs"), "terms")


def _weights(index: KeywordIndex, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, exclude_claim_id, avgdl, weight) of query terms that occur, and the queries' corpus sizes."""
    terms = write_once(query_terms(asked), "query-terms")
    known = terms.join(index.document_frequencies(terms), "term")
    corpus = index.slots().select(F.col("size").alias("docs"), "tokens")
    own = write_once(_own_claims(index, asked), "own-claims") if "exclude_claim_id" in asked.columns else None
    sizes = write_once(query_sizes(asked.drop("query_text").distinct(), corpus, own), "query-sizes")
    df = F.col("df")
    if own is not None:
        # a stored claim is not part of the corpus that its own query searches
        held = own.select("query_id", F.explode("terms").alias("term"), F.lit(1).alias("own_df")).distinct()
        known = known.join(held, ["query_id", "term"], "left")
        df = df - F.coalesce("own_df", F.lit(0))
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    known = known.join(sizes, "query_id").select("query_id", "term", "exclude_claim_id", "avgdl", (idf * F.col("qtf")).alias("weight"))
    return known, sizes


def _beside(frame: DataFrame, parts: int, label: str) -> str:
    """Store rows of queries in the blocks of their queries (``store_query_blocks``)."""
    path = shared_dir(frame.sparkSession, label)
    frame.withColumn("slot", query_slot(parts)).repartition(parts, "slot").write.partitionBy("slot").parquet(path)
    return path


def stored_candidates(
    index: KeywordIndex, queries: DataFrame, candidate_pool: int = 100, k1: float = K1, b: float = B, first_slots: int = FIRST_SLOTS
) -> tuple[DataFrame, DataFrame]:
    """Best keyword hits per query, (query_id, claim_id, bm25_score), as ``bm25_candidates`` gives them, and
    what was read for them: (query_id, slots, slots_read).

    The scale's lower end is 0 as soon as one claim does not match. One slot with a claim that does not match
    proves that; a query for which none is found (its terms may occur in every claim) is scored in all slots."""
    kind, buckets = dict(queries.dtypes)["query_id"], index.buckets
    asked = queries.select(F.col("query_id").cast("string"), "query_text", *[c for c in ("exclude_claim_id",) if c in queries.columns])
    asked = write_once(asked, "asked")
    weights, sizes = _weights(index, asked)
    path, parts = store_query_blocks(weights, asked.select("query_id").distinct().count())
    # a task sends some rows per query: slots go to so many tasks only as keep the cores busy
    tasks = 2 * index.spark.sparkContext.defaultParallelism

    def first(batches):
        yield from first_batches(batches, path, parts, first_slots, buckets, k1, b)

    seen = index.headers_by_slot().coalesce(tasks).mapInArrow(first, "query_id string, slot long, bound double, seen long, all boolean")
    seen = write_once(seen, "query-slots")
    best = top_per_query(seen.where("slot is not null"), first_slots, F.col("bound").desc(), F.col("slot")).select("query_id", F.col("slot").alias("in_slot"))
    firsts = _beside(best, parts, "first-slots")

    def scores(batches):
        yield from score_first(batches, path, firsts, parts, candidate_pool, buckets, k1, b)

    held = F.broadcast(index.spark.read.schema("query_id string, in_slot long").parquet(firsts).select(F.col("in_slot").alias("slot")).distinct())
    found = index.rows().join(held, "slot", "left_semi").coalesce(tasks).mapInArrow(scores, "query_id string, raw_score double, open boolean")
    found = write_once(found, "first-scores")
    pool = top_per_query(found.where("raw_score is not null"), candidate_pool, F.col("raw_score").desc())
    kth = pool.groupBy("query_id").agg(F.min("raw_score").alias("least"), F.count("*").alias("n")).where(F.col("n") == candidate_pool)
    opened = found.groupBy("query_id").agg(F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"))
    slots = seen.where("slot is null").groupBy("query_id").agg(F.sum("seen").alias("slots"), F.bool_and("all").alias("all"))
    proven = slots.join(opened, "query_id").select("query_id", "slots", (F.col("open") | ~F.col("all")).alias("proven"))
    limits = write_once(proven.join(kth.select("query_id", "least"), "query_id", "left"), "query-limits")
    stored = _beside(limits.where("proven and least is not null").select("query_id", "least"), parts, "limits")

    def score(batches):
        yield from score_slots(batches, path, firsts, stored, parts, candidate_pool, buckets, k1, b)

    schema = "query_id string, claim_id string, raw_score double, matched long, lowest double, slots_read long"
    scored = write_once(index.rows().coalesce(tasks).mapInArrow(score, schema), "slot-scores")
    spread = scored.groupBy("query_id").agg(
        F.sum("matched").alias("matched"), F.min("lowest").alias("lowest"), F.max("raw_score").alias("high"), F.sum("slots_read").alias("slots_read")
    )
    spread = spread.join(limits.select("query_id", "slots", "proven"), "query_id")
    spread = spread.join(sizes.groupBy("query_id").agg(F.max("n_docs").alias("n_docs")), "query_id")
    low = F.when(F.col("proven") | (F.col("matched") < F.col("n_docs")), 0.0).otherwise(F.col("lowest"))
    top = top_per_query(scored.where("raw_score is not null").select("query_id", "claim_id", "raw_score"), candidate_pool, F.col("raw_score").desc(), F.col("claim_id"))
    own_id: Column = F.col("query_id").cast(kind).alias("query_id")
    hits = top.join(spread, "query_id").select(own_id, "claim_id", scaled(F.col("raw_score"), low, F.col("high")).alias("bm25_score"))
    return hits.where("bm25_score > 0"), spread.select(own_id, "slots", F.least("slots", "slots_read").alias("slots_read"))
