"""BM25 keyword search for a table of queries, and per-query score scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossweave.functions.keywords import SCORE_DECIMALS, count_batches, count_texts, score_batches
from lossweave.functions.text import fold, raw_search_tokens, search_tokens
from lossweave.operators.filters import search_filter
from lossweave.runtime import pin_small, shared_dir, write_once
from lossweave.schema import SearchFilters

# BM25 saturation and length weight.
K1, B = 1.5, 0.75

# Queries whose terms a task holds at a time.
QUERY_BLOCK = 1024


def with_search_tokens(records: DataFrame) -> DataFrame:
    """Add the token columns that keyword search reads instead of the text when they are present."""
    tokens = search_tokens(F.col("document"))
    return records.withColumn("search_tokens", tokens).withColumn("search_token_count", F.size("search_tokens"))


def _token_columns(claims: DataFrame) -> tuple[Column, Column, bool]:
    """(tokens, token count, tokens already folded)."""
    if "search_tokens" in claims.columns:
        return F.col("search_tokens"), F.col("search_token_count"), True
    raw = raw_search_tokens(F.col("document"))
    return raw, F.size(raw), False


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated word counts as often as it is written."""
    words = queries.select("query_id", F.explode(search_tokens(F.col("query_text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def listed_tokens(claims: DataFrame) -> DataFrame:
    """(claim_id, dl, tokens): a row per claim with its folded tokens, none of them null."""
    tokens, size, folded = _token_columns(claims)
    listed = claims.select("claim_id", size.alias("dl"), tokens.alias("tokens"))
    word = lambda w: F.coalesce(w if folded else fold(w), F.lit(""))
    return listed.select("claim_id", "dl", F.transform("tokens", word).alias("tokens"))


def claim_tokens(claims: DataFrame) -> DataFrame:
    """(claim_id, dl, term): a row per token, and one with the term "" per claim."""
    tokens, size, folded = _token_columns(claims)
    # Two steps: expressions next to an explode are evaluated once per token.
    listed = claims.select("claim_id", tokens.alias("tokens"), size.alias("dl"))
    words = listed.select("claim_id", "dl", F.explode(F.array_append("tokens", F.lit(""))).alias("word"))
    # Never null: a nullable join key would be computed twice, once for a null filter.
    term = F.coalesce(F.col("word") if folded else fold(F.col("word")), F.lit(""))
    return words.select("claim_id", "dl", term.alias("term"))


def term_frequencies(claims: DataFrame) -> DataFrame:
    """(claim_id, dl, term, tf), and one row with the term "" per claim, so that corpus statistics need no second
    pass over the text."""
    return claim_tokens(claims).groupBy("claim_id", "dl", "term").agg(F.count("*").alias("tf"))


# The aggregates below all read ``tf``: they then need the same shuffled counts, which Spark computes once.


def corpus_size(tf: DataFrame) -> DataFrame:
    """One row: number of documents and of tokens."""
    per_claim = F.when(F.col("term") == "", F.col("tf"))
    return tf.agg(
        F.coalesce(F.sum(per_claim), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(per_claim * F.col("dl")), F.lit(0)).alias("n_tokens"),
    )


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


_COUNTS = "claim_id string, dl int, terms array<string>, tfs array<int>"


def counted_claims(claims: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(claim_id, dl, docs, tokens, terms, tfs, dls): a row per claim id with its different tokens (those of the few
    ``wanted`` terms, if given) and how often each stands there, stored. Counting stays inside the tasks; only ids are
    shuffled, to find those that come again. These get one row: number and tokens of its rows, its greatest length, and
    the terms of each length with that length (``dls``, else null)."""
    only = None if wanted is None else wanted.select("term").distinct().toArrow().column("term").combine_chunks()

    def count(batches):
        yield from count_batches(batches, only)

    def count_documents(batches):
        yield from count_texts(batches, only)

    if "search_tokens" in claims.columns:
        counted = listed_tokens(claims).where("tokens is not null").mapInArrow(count, _COUNTS)
    else:  # split into tokens inside the same tasks
        counted = claims.select("claim_id", F.col("document").cast("string")).mapInArrow(count_documents, _COUNTS)
    listed = write_once(counted, "token-counts", "zstd")
    single = listed.select(
        "claim_id", "dl", F.lit(1).cast("long").alias("docs"), F.col("dl").cast("long").alias("tokens"), "terms", "tfs", F.lit(None).cast("array<int>").alias("dls")
    )
    again = write_once(listed.groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("claim_id").alias("again")), "repeated-ids")
    if again.isEmpty():
        return single
    same = F.col("claim_id").eqNullSafe(F.col("again"))
    many = listed.join(again, same, "left_semi")
    sizes = many.groupBy("claim_id").agg(F.max("dl").alias("dl"), F.count("*").alias("docs"), F.sum("dl").alias("tokens"))
    words = many.select("claim_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    words = words.groupBy("claim_id", "dl", "t.terms").agg(F.sum("t.tfs").cast("int").alias("tf"))
    held = words.groupBy(F.col("claim_id").alias("held_id")).agg(F.sort_array(F.collect_list(F.struct("dl", "terms", "tf"))).alias("w"))
    merged = sizes.join(held, F.col("claim_id").eqNullSafe(F.col("held_id")), "left").withColumn("w", F.coalesce("w", F.array().cast(held.schema["w"].dataType)))
    merged = merged.select("claim_id", "dl", "docs", "tokens", F.col("w.terms"), F.col("w.tf").alias("tfs"), F.col("w.dl").alias("dls"))
    return write_once(single.join(again, same, "left_anti").unionByName(merged), "claim-counts")


def query_sizes(queries: DataFrame, counts: DataFrame, own: DataFrame | None) -> DataFrame:
    """(query_id, exclude_claim_id, n_docs, avgdl) of the corpus each query searches."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    corpus = counts.agg(total("docs"), total("tokens")).select(F.struct("docs", "tokens").alias("c")).scalar()
    if own is None:
        sizes = queries.select("query_id", F.lit(None).cast("string").alias("exclude_claim_id"))
        sizes = sizes.withColumns({"own_docs": F.lit(0), "own_tokens": F.lit(0)})
    else:
        lengths = own.groupBy("query_id").agg(F.sum("docs").alias("own_docs"), F.max("dl").alias("own_tokens"))
        sizes = queries.select("query_id", "exclude_claim_id").join(lengths, "query_id", "left")
    docs = F.col("c.docs") - F.coalesce("own_docs", F.lit(0))
    tokens = F.col("c.tokens") - F.coalesce("own_tokens", F.lit(0))
    return sizes.withColumn("c", corpus).select(
        "query_id", "exclude_claim_id", docs.alias("n_docs"), (tokens / F.nullif(docs, F.lit(0))).alias("avgdl")
    )


def query_slot(slots: int) -> Column:
    """The block of a query, by its id as text."""
    return F.pmod(F.xxhash64("query_id"), F.lit(slots))


def store_query_blocks(weights: DataFrame, n_queries: int, block: int = QUERY_BLOCK) -> tuple[str, int]:
    """Write (query_id, term, exclude_claim_id, avgdl, weight) in blocks of about ``block`` queries to shared storage, where
    the tasks read them one at a time. Returns the folder and the number of blocks."""
    slots = max(1, -(-n_queries // block))
    path = shared_dir(weights.sparkSession, "query-blocks")
    asked = weights.select("query_id", "term", "exclude_claim_id", F.col("avgdl").cast("double"), F.col("weight").cast("double"))
    asked = asked.where("weight is not null and avgdl is not null").withColumn("slot", query_slot(slots))
    asked.repartition(slots, "slot").write.partitionBy("slot").parquet(path)
    return path, slots


@dataclass(frozen=True)
class Prepared:
    """What a search needs: counts of the claims, stored weights of the queries' terms, and the queries' corpus sizes."""

    counts: DataFrame
    path: str
    slots: int
    sizes: DataFrame
    query_type: str

    def scores(self, n: int | None, k1: float, b: float) -> DataFrame:
        path, slots = self.path, self.slots

        def score(batches):
            yield from score_batches(batches, path, slots, n, k1, b)

        rows = self.counts.select("claim_id", "dl", "terms", "tfs", "dls")
        if n is not None:
            # a task sends n hits per query: claims go to so many tasks only as keep the cores busy
            rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
        scored = rows.mapInArrow(score, "query_id string, claim_id string, raw_score double, matched long, lowest double")
        return scored.withColumn("query_id", F.col("query_id").cast(self.query_type))


def _prepared(claims: DataFrame, queries: DataFrame) -> Prepared:
    own_ids = [c for c in ("exclude_claim_id",) if c in queries.columns]
    # A pinned batch has a bounded text, hence a bounded number of terms and of weights.
    queries, small = pin_small(queries)
    queries = queries if small else write_once(queries.select("query_id", "query_text", *own_ids), "asked")
    terms = query_terms(queries)
    terms = terms if small else write_once(terms, "query-terms")
    counts = counted_claims(claims, terms if small else None)
    own = None
    if "exclude_claim_id" in queries.columns:
        sources = queries.where("exclude_claim_id is not null").select("query_id", F.col("exclude_claim_id").alias("claim_id"))
        own = counts.join(F.broadcast(sources) if small else sources, "claim_id").select("query_id", "dl", "docs", "terms")
        own = write_once(own, "own-claims")
    sizes = query_sizes(queries, counts, own)
    frequencies = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(frequencies, "term").join(sizes, "query_id")
    df = F.col("df")
    if own is not None:
        own_terms = own.select("query_id", F.explode("terms").alias("term"), F.lit(1).alias("own_df"))
        weights = weights.join(own_terms, ["query_id", "term"], "left")
        df = df - F.coalesce("own_df", F.lit(0))
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    weights = weights.select(F.col("query_id").cast("string"), "term", "exclude_claim_id", "avgdl", (idf * F.col("qtf")).alias("weight"))
    path, slots = store_query_blocks(weights, queries.select("query_id").distinct().count())
    return Prepared(counts, path, slots, sizes, dict(queries.dtypes)["query_id"])


def bm25_matches(
    claims: DataFrame, queries: DataFrame, k1: float = K1, b: float = B
) -> tuple[DataFrame, DataFrame]:
    """Raw scores of matching claims, (query_id, claim_id, raw_score), and (query_id, n_docs).

    Claims without any query term have score 0 and are left out. A query made from a stored claim
    searches the corpus without that claim: the claim is taken out of the document count, the
    token count and the document frequencies of its query. Nothing of the many pairs is shuffled: tasks hold
    a chunk of claims and a block of queries at a time.
    """
    found = _prepared(claims, queries)
    return found.scores(None, k1, b).select("query_id", "claim_id", "raw_score"), found.sizes.select("query_id", "n_docs")


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a flat set becomes all 1 when positive, else all 0."""
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat & (high > 0), 1.0).when(flat, 0.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def top_per_query(hits: DataFrame, n: int, *order: Column, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First n rows per query. Spark cuts every input partition to n per query before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def bm25_candidates(
    claims: DataFrame,
    queries: DataFrame,
    filters: SearchFilters = SearchFilters(),
    candidate_pool: int = 100,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """Best keyword hits per query: (query_id, claim_id, bm25_score), scores scaled to 0..1.

    ``queries`` has query_id, query_text and optionally exclude_claim_id. Statistics are those
    of the filtered claims. Scaling runs over all filtered claims: its minimum is 0 as soon as
    one claim does not match, else the weakest match, which then scores 0 and is dropped.
    """
    found = _prepared(search_filter(claims, filters), queries)
    scores = write_once(found.scores(candidate_pool, k1, b), "keyword-hits")
    spread = scores.groupBy("query_id").agg(
        F.sum("matched").alias("matched"), F.min("lowest").alias("lowest"), F.max("raw_score").alias("high")
    )
    best = top_per_query(scores.where("matched is null"), candidate_pool, F.col("raw_score").desc(), F.col("claim_id"))
    sizes = found.sizes.select("query_id", "n_docs")
    low = F.when(F.col("matched") < F.col("n_docs"), 0.0).otherwise(F.col("lowest"))
    return (
        best.select("query_id", "claim_id", "raw_score")
        .join(spread.join(sizes, "query_id"), "query_id")
        .select("query_id", "claim_id", scaled(F.col("raw_score"), low, F.col("high")).alias("bm25_score"))
        .where("bm25_score > 0")
    )
