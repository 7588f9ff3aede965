"""Cluster the active index version and store labels, summary and map."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossweave.operators.clusters import SEED, cluster_claims, cluster_map, cluster_summary, map_projection
from lossweave.sources.store import ClaimStore, active_collection, now_utc


def build_clusters(store: ClaimStore, model_key: str, n_clusters: int = 12) -> str:
    """Returns the name of the clustered table. The labelled claims are written first and read
    back for everything after, so the fit runs once."""
    manifest = store.manifest(model_key)
    active = active_collection(manifest).first()
    if active is None:
        raise RuntimeError(f"No active index for {model_key}.")
    claims = store.read_table(active["collection_name"])
    labelled, centres = cluster_claims(claims, n_clusters)
    stamp = now_utc()
    name = f"{active['collection_name']}_clusters_{stamp.replace(':', '').replace('+', '_')}"
    store.write_table(name, labelled)
    clustered = store.read_table(name)
    index_hash = F.lit(manifest.first()["index_hash"])
    summary = cluster_summary(clustered, centres).select(
        "*",
        F.lit(min(max(1, n_clusters), clustered.count())).alias("n_clusters"),
        F.lit("KMeans").alias("algorithm"),
        F.lit(SEED).alias("random_state"),
        F.lit(stamp).alias("clustered_at_utc"),
        index_hash.alias("index_hash"),
        F.lit(name).alias("table_name"),
    )
    store.write_clusters(model_key, summary)
    if clustered.where("embedding is not null").limit(3).count() == 3:
        points = cluster_map(clustered).select(
            "*", map_projection().alias("projection"), F.lit(stamp).alias("created_at_utc"), index_hash.alias("index_hash")
        )
        store.write_cluster_map(model_key, points)
    return name
