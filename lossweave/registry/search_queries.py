"""Filters, keyword search, vector search, blending, reranking and the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossweave.operators import encode, filters as fl, fusion, keyword as kw, postings as ps, semantic as sem
from lossweave.plans.search import ranked, search
from lossweave.registry.base import index_claims, index_sql, records, register, table, tokens_sql
from lossweave.runtime import shared_dir, write_once
from lossweave.schema import EQUALITY_FIELDS, SearchFilters, SearchSpec

C = F.col
DOC_FIELDS = ("line_of_business", "claim_type", "cause_of_loss", "damaged_object", "country")

EQUAL = SearchFilters(equality={"country": "de", "claim_status": "F", "claim_type": "All", "policy_type": ""})
RANGES = SearchFilters(loss_year=(1996, 1999), reserve_amount=(50_000.0, 400_000.0), paid_amount=(None, 200_000.0))
BOTH = SearchFilters(equality={"claim_status": "O"}, loss_year=(1996, 2000), reserve_amount=(20_000.0, None))
RANGES_SQL = "loss_year BETWEEN 1996 AND 1999 AND reserve_amount BETWEEN 50000 AND 400000 AND paid_amount <= 200000"
BOTH_SQL = "claim_status = 'O' AND loss_year BETWEEN 1996 AND 2000 AND reserve_amount >= 20000"


def benchmark_queries(spark, d):
    """Every benchmark text as a free-text query."""
    return table(spark, d, "benchmark").select(C("item_id").cast("string").alias("query_id"), C("text").alias("query_text"))


def example_queries(spark, d, claims):
    """Claims marked toxic as queries by example."""
    ids = table(spark, d, "labels").where("toxic = 1").select(C("doc_id").cast("string").alias("claim_id"))
    return sem.stored_claim_queries(claims.where("embedding is not null"), ids)


BENCH_SQL = (
    "q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query_text, CAST(NULL AS VARCHAR) AS exclude_claim_id "
    "FROM benchmark)"
)
EXAMPLE_SQL = (
    "q AS (SELECT claim_id AS query_id, document AS query_text, claim_id AS exclude_claim_id, embedding FROM idx "
    "WHERE embedding IS NOT NULL AND claim_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1))"
)


def bm25_sql(where: str = "true") -> tuple[str, ...]:
    """Brute force: ``raw`` holds a score for every query and every filtered claim but its own."""
    return (
        f"dt AS (SELECT claim_id, {tokens_sql('document')} AS toks FROM idx WHERE {where})",
        f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query_text')}) AS term "
        "FROM q) GROUP BY ALL)",
        "pr AS (SELECT query_id, claim_id, len(toks) AS dl FROM q JOIN dt ON claim_id IS DISTINCT FROM exclude_claim_id)",
        "sz AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM pr GROUP BY 1)",
        "tf AS (SELECT claim_id, term, count(*) AS tf FROM (SELECT claim_id, unnest(toks) AS term FROM dt) GROUP BY ALL)",
        "ht AS (SELECT pr.query_id, claim_id, dl, term, qtf, tf FROM pr JOIN tf USING (claim_id) "
        "JOIN qt USING (query_id, term))",
        "dfq AS (SELECT query_id, term, count(*) AS df FROM ht GROUP BY ALL)",
        "sc AS (SELECT query_id, claim_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / "
        "(tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s FROM ht JOIN dfq USING (query_id, term) JOIN sz USING (query_id) "
        "GROUP BY ALL)",
        "raw AS (SELECT query_id, claim_id, coalesce(s, 0) AS raw_score FROM pr LEFT JOIN sc USING (query_id, claim_id))",
        "sp AS (SELECT query_id, min(raw_score) AS lo, max(raw_score) AS hi FROM raw GROUP BY 1)",
        "kn AS (SELECT query_id, claim_id, CASE WHEN hi - lo <= 1e-9 * hi THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END "
        "ELSE (raw_score - lo) / (hi - lo) END AS bm25_score, raw_score FROM raw JOIN sp USING (query_id))",
        "kc AS (SELECT query_id, claim_id, bm25_score FROM kn WHERE bm25_score > 0 "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, claim_id) <= 100)",
    )


def vec_sql(x: str) -> str:
    return f"CAST({x} AS DOUBLE[])"


def knn_sql(fetch: int, top_n: int, equality: str = "true", after: str = "true") -> tuple[str, ...]:
    distance = f"round(list_cosine_distance({vec_sql('i.embedding')}, {vec_sql('q.embedding')}), 12) + 0.0"
    return (
        f"nn AS (SELECT q.query_id, i.claim_id, {distance} AS distance, loss_year, reserve_amount, paid_amount, "
        f"exclude_claim_id FROM q JOIN idx i ON i.embedding IS NOT NULL AND {equality} "
        f"QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY distance, i.claim_id) <= {fetch})",
        f"sc1 AS (SELECT query_id, claim_id, distance, greatest(0.0, 1 - distance) AS semantic_score FROM nn "
        f"WHERE claim_id IS DISTINCT FROM exclude_claim_id AND {after} "
        f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, claim_id) <= {top_n})",
    )


FUSED_SQL = (
    "fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.claim_id, b.claim_id) AS claim_id, distance, "
    "coalesce(semantic_score, 0) AS semantic_score, coalesce(bm25_score, 0) AS bm25_score, "
    "0.7 * coalesce(semantic_score, 0) + 0.3 * coalesce(bm25_score, 0) AS final_score "
    "FROM sc1 a FULL JOIN kc b ON a.query_id = b.query_id AND a.claim_id = b.claim_id)"
)


@register("F2_equality_filters", index_sql("SELECT claim_id FROM idx WHERE country = 'de' AND claim_status = 'F'"))
def f2(spark, d):
    claims = records(spark, d, ("country", "claim_status", "claim_type", "policy_type"))
    return fl.search_filter(claims, EQUAL).select("claim_id")


@register("F3_range_filters", index_sql(f"SELECT claim_id FROM idx WHERE {RANGES_SQL}"))
def f3(spark, d):
    claims = records(spark, d, ("loss_date", "reserve_amount", "paid_amount"))
    return fl.search_filter(claims, RANGES).select("claim_id")


@register(
    "F11_vocabulary",
    index_sql(
        " UNION ".join(
            f"SELECT '{f}' AS field, trim(CAST({f} AS VARCHAR)) AS value FROM idx WHERE {f} IS NOT NULL"
            for f in EQUALITY_FIELDS
        )
    ),
)
def f11(spark, d):
    return fl.vocabulary(index_claims(spark, d), EQUALITY_FIELDS)


@register(
    "F12_range_domains",
    index_sql(
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, CAST(min({f}) AS DOUBLE) AS low, CAST(max({f}) AS DOUBLE) AS high FROM idx "
            f"HAVING min({f}) < max({f})"
            for f in ("loss_year", "reserve_amount", "paid_amount")
        )
    ),
)
def f12(spark, d):
    return fl.range_domains(records(spark, d, ("loss_date", "reserve_amount", "paid_amount")))


@register(
    "A3_corpus_statistics",
    index_sql(
        "SELECT term, CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl, df FROM (SELECT count(*) AS n, avg(len(toks)) AS avgdl "
        f"FROM t) , (SELECT term, count(*) AS df FROM (SELECT claim_id, unnest(list_distinct(toks)) AS term FROM t) GROUP BY 1)",
        f"t AS (SELECT claim_id, {tokens_sql('document')} AS toks FROM idx WHERE {BOTH_SQL})",
    ),
)
def a3(spark, d):
    claims = fl.search_filter(records(spark, d), BOTH)
    tf = kw.term_frequencies(claims)
    size = kw.corpus_size(tf).select(F.struct("n_docs", "n_tokens").alias("c")).scalar()
    rows = kw.document_frequencies(tf).where("term != ''").withColumn("c", size)
    mean = C("c.n_tokens") / C("c.n_docs")
    return rows.select("term", C("c.n_docs").alias("n_docs"), F.round(mean, 6).alias("avgdl"), "df")


@register(
    "M5_J10_bm25_scores",
    index_sql(
        "SELECT query_id, claim_id, raw_score AS score FROM raw WHERE raw_score > 0", BENCH_SQL, *bm25_sql()
    ),
)
def m5(spark, d):
    scores, _ = kw.bm25_matches(records(spark, d, DOC_FIELDS), benchmark_queries(spark, d))
    return scores.select("query_id", "claim_id", C("raw_score").alias("score"))


@register(
    "M6_T2_F10_keyword_search",
    index_sql(
        "SELECT query_id, claim_id, round(bm25_score, 6) AS bm25_score, "
        "CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, claim_id) AS INTEGER) AS rank FROM kc",
        BENCH_SQL,
        *bm25_sql(),
    ),
)
def m6(spark, d):
    hits = kw.bm25_candidates(records(spark, d, DOC_FIELDS), benchmark_queries(spark, d))
    return ranked(hits.withColumn("final_score", C("bm25_score"))).select(
        "query_id", "claim_id", F.round("bm25_score", 6).alias("bm25_score"), "rank"
    )


def stored_index(spark, d):
    """A keyword index of all claims, written and read back."""
    path = shared_dir(spark, "postings")
    ps.write_postings(records(spark, d, DOC_FIELDS), path)
    return ps.KeywordIndex(spark, path)


@register(
    "A3_stored_statistics",
    index_sql(
        "SELECT term, CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl, df FROM (SELECT count(*) AS n, avg(len(toks)) AS avgdl "
        f"FROM t) , (SELECT term, count(*) AS df FROM (SELECT claim_id, unnest(list_distinct(toks)) AS term FROM t) GROUP BY 1)",
        f"t AS (SELECT claim_id, {tokens_sql('document')} AS toks FROM idx)",
    ),
)
def a3_stored(spark, d):
    index = stored_index(spark, d)
    size = index.corpus_size().select(F.struct("n_docs", "n_tokens").alias("c")).scalar()
    rows = index.document_frequencies().withColumn("c", size)
    return rows.select("term", C("c.n_docs").alias("n_docs"), F.round(C("c.n_tokens") / C("c.n_docs"), 6).alias("avgdl"), "df")


@register(
    "M6_A3_J10_stored_postings",
    index_sql(
        "SELECT query_id, claim_id, round(bm25_score, 6) AS bm25_score, "
        "CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, claim_id) AS INTEGER) AS rank FROM kc",
        BENCH_SQL,
        *bm25_sql(),
    ),
)
def m6_stored(spark, d):
    hits, _ = ps.stored_candidates(stored_index(spark, d), benchmark_queries(spark, d))
    return ranked(hits.withColumn("final_score", C("bm25_score"))).select(
        "query_id", "claim_id", F.round("bm25_score", 6).alias("bm25_score"), "rank"
    )


@register(
    "M6_F9_stored_by_example",
    index_sql("SELECT query_id, claim_id, round(bm25_score, 6) AS bm25_score FROM kc", EXAMPLE_SQL, *bm25_sql()),
)
def m6_stored_by_example(spark, d):
    queries = example_queries(spark, d, index_claims(spark, d, DOC_FIELDS))
    hits, _ = ps.stored_candidates(stored_index(spark, d), queries)
    return hits.select("query_id", "claim_id", F.round("bm25_score", 6).alias("bm25_score"))


@register(
    "M6_F9_filtered_by_example",
    index_sql(
        "SELECT query_id, claim_id, round(bm25_score, 6) AS bm25_score FROM kc", EXAMPLE_SQL, *bm25_sql(BOTH_SQL)
    ),
)
def m6_filtered(spark, d):
    claims = index_claims(spark, d)
    hits = kw.bm25_candidates(claims, example_queries(spark, d, claims), BOTH)
    return hits.select("query_id", "claim_id", F.round("bm25_score", 6).alias("bm25_score"))


@register(
    "M7_min_max_scores",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 1.0 WHEN l_orderkey % 5 = 1 THEN 0.0
      ELSE l_extendedprice END AS v FROM lineitem), b AS (SELECT l_orderkey, min(v) lo, max(v) hi FROM s GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN hi - lo <= 1e-9 * hi THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END
      ELSE (v - lo) / (hi - lo) END, 6) AS scaled FROM s JOIN b USING (l_orderkey)""",
)
def m7(spark, d):
    key = C("l_orderkey")
    value = F.when(key % 5 == 0, 1.0).when(key % 5 == 1, 0.0).otherwise(C("l_extendedprice"))
    rows = table(spark, d, "lineitem").select(
        key.alias("query_id"), C("l_linenumber"), value.alias("pair_score")
    )
    scaled = fusion.apply_rerank_scores(rows)
    return scaled.select(
        C("query_id").alias("l_orderkey"), "l_linenumber", F.round("rerank_score", 6).alias("scaled")
    )


@register(
    "M2_J9_T1_nearest_claims",
    index_sql(
        "SELECT query_id, claim_id, round(distance, 6) AS distance, round(semantic_score, 6) AS similarity FROM sc1",
        "q AS (SELECT claim_id AS query_id, CAST(NULL AS VARCHAR) AS exclude_claim_id, embedding FROM idx "
        "WHERE embedding IS NOT NULL)",
        *knn_sql(50, 10),
    ),
)
def m2(spark, d):
    claims = index_claims(spark, d, ())
    queries = claims.where("embedding is not null").select(C("claim_id").alias("query_id"), "embedding")
    hits = sem.similar_claims(claims, queries, top_n=10)
    return hits.select(
        "query_id", "claim_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity")
    )


@register(
    "M2_filtered_nearest",
    index_sql(
        "SELECT query_id, claim_id, round(distance, 6) AS distance FROM sc1",
        EXAMPLE_SQL,
        *knn_sql(50, 10, "i.claim_status = 'O'", "loss_year BETWEEN 1996 AND 2000 AND reserve_amount >= 20000"),
    ),
)
def m2_filtered(spark, d):
    claims = index_claims(spark, d)
    hits = sem.similar_claims(claims, example_queries(spark, d, claims), BOTH, top_n=10, postfilter_ranges=True)
    return hits.select("query_id", "claim_id", F.round("distance", 6).alias("distance"))


@register(
    "M2_prefiltered_nearest",
    index_sql(
        "SELECT query_id, claim_id, round(distance, 6) AS distance FROM sc1",
        EXAMPLE_SQL,
        *knn_sql(50, 10, f"i.claim_status = 'O' AND i.loss_year BETWEEN 1996 AND 2000 AND i.reserve_amount >= 20000"),
    ),
)
def m2_prefiltered(spark, d):
    claims = index_claims(spark, d)
    hits = sem.similar_claims(claims, example_queries(spark, d, claims), BOTH, top_n=10)
    return hits.select("query_id", "claim_id", F.round("distance", 6).alias("distance"))


@register(
    "M4_F9_query_by_example",
    index_sql(
        "SELECT query_id, claim_id, round(distance, 6) AS distance FROM sc1", EXAMPLE_SQL, *knn_sql(50, 10)
    ),
)
def m4(spark, d):
    claims = index_claims(spark, d)
    hits = sem.similar_claims(claims, example_queries(spark, d, claims), top_n=10)
    return hits.select("query_id", "claim_id", F.round("distance", 6).alias("distance"))


def _fused(spark, d):
    claims = index_claims(spark, d)
    queries = write_once(example_queries(spark, d, claims), "queries")  # both searches read them several times
    close = sem.similar_claims(claims, queries, top_n=100)
    words = kw.bm25_candidates(claims, queries)
    return fusion.fuse(close, words, "Hybrid", 0.7)


@register(
    "M8_J1_U1_hybrid_fusion",
    index_sql(
        "SELECT query_id, claim_id, round(distance, 6) AS distance, round(semantic_score, 6) AS semantic_score, "
        "round(bm25_score, 6) AS bm25_score, round(final_score, 6) AS final_score FROM fu",
        EXAMPLE_SQL,
        *knn_sql(101, 100),
        *bm25_sql(),
        FUSED_SQL,
    ),
)
def m8(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("distance", "semantic_score", "bm25_score", "final_score")]
    return _fused(spark, d).select("query_id", "claim_id", *rounded)


def _overlap_sql(q: str, d: str) -> str:
    return (
        f"len(list_intersect(list_distinct({tokens_sql(q)}), list_distinct({tokens_sql(d)}))) * 1.0 / "
        f"len(list_distinct(list_concat({tokens_sql(q)}, {tokens_sql(d)})))"
    )


@register(
    "M9_rerank",
    index_sql(
        "SELECT query_id, claim_id, round(CASE WHEN hi - lo <= 1e-9 * hi THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END "
        "ELSE (p - lo) / (hi - lo) END, 6) AS rerank_score FROM (SELECT query_id, claim_id, p, "
        "min(p) OVER (PARTITION BY query_id) AS lo, max(p) OVER (PARTITION BY query_id) AS hi FROM pairs)",
        BENCH_SQL,
        *bm25_sql(),
        "head AS (SELECT query_id, claim_id FROM kc "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, claim_id) <= 50)",
        f"pairs AS (SELECT query_id, claim_id, {_overlap_sql('query_text', 'document')} AS p "
        "FROM head JOIN q USING (query_id) JOIN idx USING (claim_id))",
    ),
)
def m9(spark, d):
    claims = records(spark, d, DOC_FIELDS)
    queries = benchmark_queries(spark, d)
    hits = kw.bm25_candidates(claims, queries).withColumn("final_score", C("bm25_score"))
    pairs = hits.join(queries, "query_id").join(claims.select("claim_id", "document"), "claim_id")
    return fusion.rerank(pairs, 50).select("query_id", "claim_id", F.round("rerank_score", 6).alias("rerank_score"))


@register(
    "M10_W4_T3_search",
    index_sql(
        "SELECT query_id, claim_id, country, loss_year, round(final_score, 6) AS final_score, "
        "CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, claim_id) AS INTEGER) AS rank "
        "FROM fu JOIN idx USING (claim_id) "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, claim_id) <= 10",
        EXAMPLE_SQL,
        *knn_sql(101, 100, "i.claim_status = 'O' AND i.loss_year BETWEEN 1996 AND 2000 AND i.reserve_amount >= 20000"),
        *bm25_sql(BOTH_SQL),
        FUSED_SQL,
    ),
)
def m10(spark, d):
    claims = index_claims(spark, d)
    hits = search(claims, example_queries(spark, d, claims), SearchSpec(mode="Hybrid", filters=BOTH))
    return hits.select(
        "query_id", "claim_id", "country", "loss_year", F.round("final_score", 6).alias("final_score"), "rank"
    )


@register(
    "M10_T2_keyword_search_reranked",
    index_sql(
        "SELECT query_id, claim_id, round(p, 6) AS final_score, "
        "CAST(row_number() OVER (PARTITION BY query_id ORDER BY p DESC, claim_id) AS INTEGER) AS rank FROM ("
        "SELECT query_id, claim_id, CASE WHEN hi - lo <= 1e-9 * hi THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END "
        "ELSE (p - lo) / (hi - lo) END AS p FROM (SELECT query_id, claim_id, p, "
        "min(p) OVER (PARTITION BY query_id) AS lo, max(p) OVER (PARTITION BY query_id) AS hi FROM pairs)) "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p DESC, claim_id) <= 5",
        BENCH_SQL,
        *bm25_sql(),
        "head AS (SELECT query_id, claim_id FROM kc "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, claim_id) <= 50)",
        f"pairs AS (SELECT query_id, claim_id, {_overlap_sql('query_text', 'document')} AS p "
        "FROM head JOIN q USING (query_id) JOIN idx USING (claim_id))",
    ),
)
def m10_reranked(spark, d):
    claims = records(spark, d, DOC_FIELDS)
    spec = SearchSpec(mode="BM25", top_n=5, rerank=True)
    hits = search(claims, benchmark_queries(spark, d), spec)
    return hits.select("query_id", "claim_id", F.round("final_score", 6).alias("final_score"), "rank")


@register("M1_lexical_vectors")
def m1(spark, d):
    """Search by lexical vectors made from the documents, for every benchmark text."""
    claims = records(spark, d, DOC_FIELDS)
    model = encode.fit_lexical_encoder(claims)
    queries = encode.lexical_encode(benchmark_queries(spark, d), model, "query_text")
    return sem.similar_claims(encode.lexical_encode(claims, model), queries, top_n=10)
