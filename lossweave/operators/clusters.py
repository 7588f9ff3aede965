"""k-means clusters, their centroids, keywords, representatives, common values and 2-D map."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.storagelevel import StorageLevel

from lossweave.functions.stopwords import STOP_WORDS
from lossweave.functions.text import document_description, keyword_text, keyword_tokens, title_case
from lossweave.functions.vectors import unit_vector
from lossweave.operators.semantic import nearest_claims
from lossweave.runtime import pin_small
from lossweave.schema import PROFILE_FIELDS

SEED = 42
TOP_TERMS = 10
LABEL_TERMS = 3
REPRESENTATIVES = 3
TOP_VALUES = 5

# Below this many rows per task, k-means spends its time on starting tasks.
_ROWS_PER_TASK = 2_000


def _unit_vectors(claims: DataFrame) -> DataFrame:
    vectors = claims.withColumn("raw_vector", array_to_vector("embedding"))
    return Normalizer(inputCol="raw_vector", outputCol="features", p=2.0).transform(vectors).drop("raw_vector")


def cluster_claims(
    claims: DataFrame, n_clusters: int = 12, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Claims with their k-means ``cluster_id``, and (cluster_id, centroid) with unit-length centres.

    k-means runs over unit vectors in a fixed row layout, so that two runs agree. Claims without
    a vector keep a null cluster. Labels are added to the rows in place, without a join.
    """
    with_vector = claims.where("embedding is not null").drop("cluster_id")
    n_rows = with_vector.count()
    if n_rows == 0:
        raise ValueError("Clustering needs claims with a vector; there are none.")
    k = min(max(1, n_clusters), n_rows)
    if k == 1:
        labelled = with_vector.withColumn("cluster_id", F.lit(0))
        centres = centroids(labelled)
    else:
        most = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = partitions or min(most, -(-n_rows // _ROWS_PER_TASK))
        rows = _unit_vectors(with_vector).select("claim_id", "features")
        rows = rows.repartition(parts, "claim_id").sortWithinPartitions("claim_id").persist(StorageLevel.MEMORY_AND_DISK)
        model = KMeans(k=k, seed=SEED, maxIter=100, featuresCol="features", predictionCol="cluster_id").fit(rows)
        rows.unpersist()
        labelled = model.transform(_unit_vectors(with_vector)).drop("features")
        centres = _model_centroids(claims, model)
    rest = claims.drop("cluster_id").where("embedding is null").withColumn("cluster_id", F.lit(None).cast("int"))
    return labelled.unionByName(rest), centres


def _model_centroids(claims: DataFrame, model: KMeansModel) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    raw = claims.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>")
    return raw.select("cluster_id", unit_vector(F.col("centroid")).alias("centroid"))


def centroids(clustered: DataFrame) -> DataFrame:
    """(cluster_id, centroid): mean of the unit vectors per given label, scaled to unit length."""
    rows = clustered.where("embedding is not null and cluster_id is not null").select(
        "cluster_id", array_to_vector(unit_vector(F.col("embedding"))).alias("v")
    )
    mean = rows.groupBy("cluster_id").agg(Summarizer.mean(F.col("v")).alias("m"))
    return mean.select("cluster_id", unit_vector(vector_to_array("m")).alias("centroid"))


def representatives(clustered: DataFrame, centres: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """(cluster_id, claim_id, distance, rank): the claims of each cluster closest to its centroid."""
    own = centres.select(F.col("cluster_id").cast("string").alias("query_id"), F.col("centroid").alias("embedding"))
    probes = centres.select(F.col("cluster_id").cast("string").alias("query_id"), F.col("cluster_id").alias("cell"))
    hits = nearest_claims(clustered, own, n, cell="cluster_id", probes=probes)
    order = Window.partitionBy("query_id").orderBy("distance", "claim_id")
    return hits.select(
        F.col("query_id").cast("int").alias("cluster_id"), "claim_id", "distance", F.row_number().over(order).alias("rank")
    )


def term_scores(clustered: DataFrame, text: Column, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(cluster_id, term, term_count, df, score) of cluster keywords.

    One pass over the tokens: they are sorted within their document, so that the first of equal
    tokens can be marked and document frequencies come from the same grouped counts. Counts are
    combined on the map side, hence a cluster or a term of any size is fine.
    """
    docs = clustered.where("cluster_id is not null")
    total = docs.agg(F.count("*").alias("n")).scalar()
    words = docs.select("cluster_id", F.array_sort(keyword_tokens(text, stop_words)).alias("words"))
    marked = F.transform(
        F.col("words"),
        lambda w, i: F.struct(
            w.alias("term"), F.when((i > 0) & (w == F.get(F.col("words"), i - 1)), 0).otherwise(1).alias("first")
        ),
    )
    counts = (
        words.select("cluster_id", F.explode(marked).alias("t"))
        .groupBy("cluster_id", "t.term")
        .agg(F.count("*").alias("term_count"), F.sum("t.first").alias("docs"))
    )
    df = F.sum("docs").over(Window.partitionBy("term"))
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    return (
        counts.withColumn("df", df)
        .select("cluster_id", "term", "term_count", "df", F.round(F.col("term_count") * idf, 9).alias("score"))
    )


def top_terms(scores: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """(cluster_id, term, score, rank): best terms per cluster, alphabetical on ties."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), F.col("term"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cluster_terms(clustered: DataFrame, n: int = TOP_TERMS, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    return top_terms(term_scores(clustered, keyword_text(F.col("document")), stop_words), n)


def value_counts(claims: DataFrame, fields: Iterable[str] = PROFILE_FIELDS, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, field, value, count) of non-null values, all fields in one pass."""
    keys = list(keys)
    present = [f for f in fields if f in claims.columns]
    rows = claims.select(*keys, *[F.col(f).cast("string").alias(f"v_{f}") for f in present])
    long = rows.unpivot(keys, [f"v_{f}" for f in present], "field", "value").where("value is not null")
    return long.groupBy(*keys, F.substring("field", 3, 100).alias("field"), "value").agg(F.count("*").alias("count"))


def top_values(counts: DataFrame, keys: Iterable[str] = (), n: int = TOP_VALUES) -> DataFrame:
    """Most frequent values per field (and key), value order on ties."""
    order = Window.partitionBy(*keys, "field").orderBy(F.col("count").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def common_values(
    claims: DataFrame, keys: Iterable[str] = (), *, fields: Iterable[str] = PROFILE_FIELDS, keep_empty: bool = False
) -> DataFrame:
    """``common_metadata`` per key: map from field to its top values with counts."""
    keys = list(keys)
    best = top_values(value_counts(claims, fields, keys), keys)
    lists = best.groupBy(*keys, "field").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("l"))
    lists = lists.withColumn("l", F.transform("l", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "l"))))
    maps = lists.groupBy(*keys).agg(entries.alias("common_metadata"))
    if not keep_empty:
        return maps
    empty = F.array().cast("array<struct<value:string,count:bigint>>")
    filled = [
        F.struct(F.lit(f), F.coalesce(F.try_element_at("common_metadata", F.lit(f)), empty))
        for f in fields
        if f in claims.columns
    ]
    return maps.withColumn("common_metadata", F.map_from_entries(F.array(*filled)))


def cluster_summary(
    clustered: DataFrame, centres: DataFrame | None = None, stop_words: Iterable[str] = STOP_WORDS
) -> DataFrame:
    """One row per cluster: label, size, representatives, frequent terms and common values."""
    member = clustered.where("cluster_id is not null")
    sizes = member.groupBy("cluster_id").agg(F.count("*").alias("size"))
    terms = cluster_terms(member, TOP_TERMS, stop_words)
    terms = terms.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term")))["term"].alias("frequent_terms"))
    centres, few = pin_small(centroids(member) if centres is None else centres)
    reps = representatives(member, centres)
    # At most three rows per cluster: with a measured number of clusters they go to the documents.
    shown = member.select("claim_id", "document").join(F.broadcast(reps) if few else reps, "claim_id")
    one = F.struct("rank", "claim_id", document_description(F.col("document")).alias("description"))
    shown = shown.groupBy("cluster_id").agg(F.sort_array(F.collect_list(one)).alias("r"))
    shown = shown.select(
        "cluster_id",
        F.transform("r", lambda e: F.struct(e["claim_id"].alias("claim_id"), e["description"].alias("description"))).alias(
            "representative_claims"
        ),
    )
    parts = sizes.join(terms, "cluster_id", "left").join(shown, "cluster_id", "left")
    parts = parts.join(common_values(member, ["cluster_id"]), "cluster_id", "left")
    words = F.coalesce("frequent_terms", F.array().cast("array<string>"))
    plain = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    label = F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, LABEL_TERMS), " / ")).otherwise(plain)
    return parts.select(
        "cluster_id",
        title_case(label).alias("label"),
        "size",
        "representative_claims",
        words.alias("frequent_terms"),
        "common_metadata",
    )


def cluster_map(clustered: DataFrame) -> DataFrame:
    """(claim_id, cluster_id, x, y, description): the first two principal components of the unit vectors."""
    rows = clustered.where("embedding is not null")
    if rows.limit(3).count() < 3:
        raise ValueError("A map of clusters takes three vectors or more.")
    vectors = rows.select("claim_id", "cluster_id", "document", array_to_vector(unit_vector(F.col("embedding"))).alias("v"))
    flat = vector_to_array(F.col("p"))
    points = PCA(k=2, inputCol="v", outputCol="p").fit(vectors.select("v")).transform(vectors)
    return points.select(
        "claim_id",
        "cluster_id",
        flat[0].alias("x"),
        flat[1].alias("y"),
        document_description(F.col("document")).alias("description"),
    )


def map_projection() -> Column:
    """How the map was made."""
    return F.struct(
        F.lit("PCA").alias("method"),
        F.lit("cosine").alias("metric"),
        F.lit(SEED).alias("random_state"),
        F.lit(None).cast(T.IntegerType()).alias("n_neighbors"),
    )
