"""The whole search: filter, candidates, blend, rerank, ranked page of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lossweave.functions.text import clean_text
from lossweave.operators.fusion import Scorer, fuse, rescore
from lossweave.operators.keyword import bm25_candidates, top_per_query
from lossweave.operators.semantic import similar_claims
from lossweave.runtime import BROADCAST_ROWS, pin_small, write_once
from lossweave.schema import SearchSpec


def ranked(hits: DataFrame) -> DataFrame:
    """Number the hits of each query by final score, ids on ties."""
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("claim_id"))
    return hits.withColumn("rank", F.row_number().over(order))


def with_claims(hits: DataFrame, claims: DataFrame, max_hits: int) -> DataFrame:
    """Claim columns of the hits. Hits are few by construction, so they go to the claims."""
    attributes = claims.drop("embedding", "search_tokens", "search_token_count")
    return attributes.join(F.broadcast(hits) if max_hits <= BROADCAST_ROWS else hits, "claim_id")


def search(claims: DataFrame, queries: DataFrame, spec: SearchSpec = SearchSpec(), scorer: Scorer | None = None) -> DataFrame:
    """Answer a table of queries: (query_id, query_text, [embedding], [exclude_claim_id]) to ranked hits.

    Queries with a blank text are not searched.
    """
    asked = queries.where(clean_text(F.col("query_text")) != "").withColumn("query_id", F.col("query_id").cast("string"))
    asked, small = pin_small(asked)
    asked = asked if small else write_once(asked, "asked")  # both searches, their number and the pairs read them
    semantic = keyword = None
    if spec.mode in ("Semantic", "Hybrid"):
        semantic = similar_claims(claims, asked, spec.filters, spec.candidate_pool)
    if spec.mode in ("BM25", "Hybrid"):
        keyword = bm25_candidates(claims, asked, spec.filters, spec.candidate_pool)
    hits = fuse(semantic, keyword, spec.mode, spec.semantic_weight)
    n_queries = asked.count()
    if spec.rerank:
        depth = spec.rerank_depth
        head = top_per_query(hits, depth, F.col("final_score").desc(), F.col("claim_id"))
        texts = with_claims(head, claims.select("claim_id", "document"), n_queries * depth)
        texts_asked = asked.select("query_id", "query_text")
        pairs = texts.join(F.broadcast(texts_asked) if small else texts_asked, "query_id")
        hits = rescore(pairs, scorer).drop("query_text", "document")
    page = ranked(hits).where(F.col("rank") <= spec.top_n)
    return with_claims(page, claims, n_queries * spec.top_n)
