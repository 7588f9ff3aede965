"""Cosine nearest-neighbour search for a table of query vectors, exact and by cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lossweave.functions.values import similarity
from lossweave.functions.vectors import closest_batches, nearest_batches
from lossweave.operators.filters import equality, ranges
from lossweave.operators.keyword import top_per_query
from lossweave.runtime import shared_dir, write_once
from lossweave.schema import SearchFilters

# Vectors (queries or centroids) that a task holds at a time.
QUERY_BLOCK = 4096
# Claims whose distances give each query its first bound.
SAMPLE = 2048
# How much larger each further sample is at most.
STEP = 8
# Hits of a query are cut in so many groups first, so that the final cut sees few rows per query.
MERGE_GROUPS = 32

_HIT_SCHEMA = "query_id string, claim_id string, distance double"


def _store_blocks(vectors: DataFrame, block: int, rows: int | None = None) -> tuple[str, int]:
    """Write vectors (id, vector, ...) in blocks of about ``block`` rows to shared storage, where the tasks
    read them one at a time: no vector passes through the driver. Returns the folder and the block count.
    ``rows`` tells the number of ids that are known to be unique."""
    key = vectors.columns[0]
    if rows is None:
        rows = unique_rows(vectors, key)
    slots = max(1, -(-rows // block))
    path = shared_dir(vectors.sparkSession, "vectors")
    slotted = vectors.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)))
    slotted.repartition(slots, "slot").write.partitionBy("slot").parquet(path)
    return path, slots


def unique_rows(vectors: DataFrame, key: str) -> int:
    """The number of rows, which all have a key of their own."""
    checked = vectors.groupBy(key).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    if (checked["most"] or 0) > 1:
        raise ValueError(f"{key} is not unique among the vectors")
    return checked["rows"] or 0


def _task_hits(vectors: DataFrame, asked: DataFrame, rows: int, n: int, by_cell: bool, block: int) -> DataFrame:
    """(query_id, claim_id, distance): at most n hits per query and task."""
    path, slots = _store_blocks(asked, block, rows)

    def score(batches):
        yield from nearest_batches(batches, path, slots, n, by_cell)

    return vectors.mapInArrow(score, _HIT_SCHEMA)


def first_bounds(vectors: DataFrame, asked: DataFrame, rows: int, n: int, by_cell: bool, block: int, sample: int) -> DataFrame:
    """``asked`` with ``bound`` and ``bound_id``: distance and id of the n-th nearest in a sample of the claims, which
    the n-th nearest of all claims does not come after. Infinity where the sample has fewer than n.

    The first sample of about ``sample`` claims goes to one task; each further one is larger by the same factor of
    STEP at most, and is searched with the bounds of the one before; all claims are the last. So a search emits
    about STEP times n hits per query at most, however many claims and tasks there are."""
    total = vectors.count()
    searches = max(1, math.ceil(math.log(max(1.0, total / sample), STEP)))
    factor = max(1.0, total / sample) ** (1 / searches)
    known = asked.withColumns({"bound": F.lit(float("inf")), "bound_id": F.lit(None).cast("string")})
    for number in range(searches):
        some = vectors.sample(fraction=min(1.0, sample * factor**number / max(1, total)), seed=number)
        some = some if number else some.repartition(1)
        hits = top_per_query(_task_hits(some, known, rows, n, by_cell, block), n, F.col("distance"), F.col("claim_id"))
        last = F.max(F.struct("distance", "claim_id")).alias("last")
        nth = hits.groupBy("query_id").agg(last, F.count("*").alias("found")).where(F.col("found") == n)
        nth = nth.select("query_id", F.col("last.distance").alias("bound"), F.col("last.claim_id").alias("bound_id"))
        known = asked.join(nth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        known = write_once(known, "bounds") if number + 1 < searches else known
    return known


def nearest_claims(
    claims: DataFrame,
    queries: DataFrame,
    n: int,
    *,
    cell: str | None = None,
    probes: DataFrame | None = None,
    block: int = QUERY_BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """The n nearest claims of each query: (query_id, claim_id, distance), ties in id order.

    A sample of the claims gives every query a first bound. Then one pass over the claims: every task groups its
    rows into balls, skips those that lie beyond a query's bound, scores the others against the stored blocks
    of query vectors as matrix products, and emits n rows per query at most, however many rows it has. Hits are
    cut to n per query in two levels. With ``cell`` and ``probes`` (query_id, cell), a query only sees the
    claims of its cells. A repeated query id is an error. ``sample=0`` goes without first bounds.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").where("embedding is not null")
    vectors = claims.select("claim_id", "embedding", *([cell] if cell else [])).where("embedding is not null")
    if cell:
        lists = probes.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(
            F.collect_set(F.col("cell").cast("int")).alias("cells")
        )
        asked = asked.join(lists, "query_id")
        wanted = probes.select(F.col("cell").cast("int").alias(cell)).distinct()
        vectors = vectors.join(wanted, cell, "left_semi").select("claim_id", "embedding", F.col(cell).cast("int"))
    asked = write_once(asked, "queries")
    rows = unique_rows(asked, "query_id")
    if sample:
        vectors = write_once(vectors, "claim-vectors")  # counted, sampled and searched: whatever makes them runs once
        asked = first_bounds(vectors, asked, rows, n, cell is not None, block, sample)
    else:
        asked = asked.withColumns({"bound": F.lit(float("inf")), "bound_id": F.lit(None).cast("string")})
    hits = _task_hits(vectors, asked, rows, n, cell is not None, block)
    order = (F.col("distance"), F.col("claim_id"))
    grouped = hits.withColumn("_group", F.pmod(F.xxhash64("claim_id"), F.lit(MERGE_GROUPS)))
    return top_per_query(top_per_query(grouped, n, *order, keys=("query_id", "_group")).drop("_group"), n, *order)


def similar_claims(
    claims: DataFrame,
    queries: DataFrame,
    filters: SearchFilters = SearchFilters(),
    top_n: int = 10,
    candidate_multiplier: int = 4,
    *,
    postfilter_ranges: bool = False,
    cell: str | None = None,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Semantic hits per query: (query_id, claim_id, distance, similarity, semantic_score).

    ``queries`` has query_id, embedding and optionally exclude_claim_id. All filters come before the search,
    so a query gets top_n hits if so many claims match. ``postfilter_ranges`` takes ranges out of
    ``top_n * candidate_multiplier`` candidates (50 at least) instead: cheaper where ranges are costly to
    test, but possibly with fewer hits.
    """
    has_own = "exclude_claim_id" in queries.columns
    fetch = max(top_n * candidate_multiplier, top_n, 50) if postfilter_ranges else top_n + has_own
    allowed = claims.where(equality(claims, filters))
    if not postfilter_ranges:
        allowed = allowed.where(ranges(allowed, filters))
    hits = nearest_claims(allowed, queries, fetch, cell=cell, probes=probes)
    if has_own:
        own = queries.where("exclude_claim_id is not null").select(
            F.col("query_id").cast("string").alias("query_id"), F.col("exclude_claim_id").alias("claim_id")
        )
        hits = hits.join(own, ["query_id", "claim_id"], "left_anti")
    if postfilter_ranges and filters != SearchFilters(equality=filters.equality):
        hits = hits.join(allowed.where(ranges(allowed, filters)).select("claim_id"), "claim_id", "left_semi")
    close = similarity(F.col("distance"))
    best = top_per_query(hits, top_n, F.col("distance"), F.col("claim_id"))
    return best.select("query_id", "claim_id", "distance", close.alias("similarity"), close.alias("semantic_score"))


def stored_claim_queries(claims: DataFrame, claim_ids: DataFrame) -> DataFrame:
    """Stored claims as queries: their document and vector search for others like them."""
    chosen = claims.join(claim_ids.select("claim_id").distinct(), "claim_id", "left_semi")
    keep = [c for c in ("embedding",) if c in claims.columns]
    return chosen.select(
        F.col("claim_id").alias("query_id"),
        F.col("document").alias("query_text"),
        F.col("claim_id").alias("exclude_claim_id"),
        *keep,
    )


def assign_nearest(claims: DataFrame, centroids: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(claim_id, cluster_id, distance) with the nearest centroid of each claim, lowest id on ties."""
    vectors = claims.select("claim_id", "embedding").where("embedding is not null")
    targets = centroids.select(F.col("cluster_id").cast("int").alias("cluster_id"), "centroid").where("centroid is not null")
    targets = write_once(targets, "targets")
    path, slots = _store_blocks(targets, block)
    if targets.isEmpty():
        raise ValueError("No centroids.")

    def closest(batches):
        yield from closest_batches(batches, path, slots)

    return vectors.mapInArrow(closest, "claim_id string, cluster_id int, distance double")


def nearest_cells(queries: DataFrame, centroids: DataFrame, n_probes: int) -> DataFrame:
    """(query_id, cell): the cells whose centroids are nearest to each query."""
    cells = centroids.select(F.col("cluster_id").cast("string").alias("claim_id"), F.col("centroid").alias("embedding"))
    probes = nearest_claims(cells, queries, n_probes)
    return probes.select("query_id", F.col("claim_id").cast("int").alias("cell"))


def scored_fraction(claims: DataFrame, queries: DataFrame, probes: DataFrame, cell: str) -> DataFrame:
    """Share of all (query, claim) pairs that a cell search scores, from cell sizes alone."""
    sizes = claims.where("embedding is not null").groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("t")).scalar()
    asked = queries.agg(F.count("*").alias("q")).scalar()
    seen = probes.join(sizes, "cell").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("seen"))
    return seen.select((F.col("seen") / (total * asked)).alias("fraction"))
