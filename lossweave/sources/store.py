"""Versioned claim tables, manifests and cluster artefacts below one folder.

Tables are immutable Parquet folders named after their content hash. A table either holds whole rows, or rows
without texts: these name the part (``text_part``) that holds their text with its tokens and vector, by the text's
hash, so that versions share the texts they have in common. Parts are never changed either. Manifests and artefacts
are append-only JSON logs whose newest entry counts, so a job that dies half-way never leaves
the store without an active version.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lossweave.operators.ingest import one_per_id
from lossweave.schema import CLUSTER_MAP_SCHEMA, CLUSTER_SCHEMA, MANIFEST_SCHEMA

# Texts and vectors hardly repeat: looking for values to name in a dictionary costs more than it saves.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("document", "claim_description", "embedding.list.element")}
TEXT_COLUMNS = ("document", "claim_description", "embedding", "search_tokens", "search_token_count")


def now_utc() -> str:
    return datetime.now(UTC).isoformat()


def storage_key(model_key: str) -> str:
    """Model key in a form that is safe in folder names."""
    return re.sub(r"[^0-9A-Za-z_-]+", "_", model_key).strip("_").replace("-", "_").lower()


def version_name(base: str, model_key: str, index_hash: str) -> str:
    return f"{base}_{storage_key(model_key)}_{index_hash[:12]}"


def upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with the same id."""
    fresh = one_per_id(new)
    untouched = base.join(new.select("claim_id").distinct(), "claim_id", "left_anti")
    return untouched.unionByName(fresh, allowMissingColumns=True)


def patch(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite columns by id; null updates and ids without an update leave the old values. Of several
    updates of one id the one with the greatest hash of its values counts, so no row is multiplied."""
    changed = [c for c in updates.columns if c != "claim_id"]
    if not changed:
        return base
    new = F.struct(*[F.col(c).alias(f"new_{c}") for c in changed])
    side = updates.groupBy("claim_id").agg(F.max_by(new, F.xxhash64(*changed)).alias("new")).select("claim_id", "new.*")
    joined = base.join(side, "claim_id", "left")
    kept = [F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns]
    added = [F.col(f"new_{c}").alias(c) for c in changed if c not in base.columns]
    return joined.select(*kept, *added)


def lookup(claims: DataFrame, claim_id: str) -> DataFrame:
    return claims.where(F.col("claim_id") == claim_id).limit(1)


def lookup_many(claims: DataFrame, ids: DataFrame) -> DataFrame:
    return claims.join(ids.select("claim_id").distinct(), "claim_id", "left_semi")


def matching_artefacts(artefacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artefacts made for the active index; a manifest without a hash lets all of them through."""
    active = manifest.select(F.struct("index_hash").alias("m")).scalar()
    checked = artefacts.withColumn("active", active)
    hash_ = F.coalesce(F.col("active.index_hash"), F.lit(""))
    return checked.where((hash_ == "") | (F.col("index_hash") == hash_)).drop("active")


def active_collection(manifest: DataFrame) -> DataFrame:
    """The active table name, if the manifest carries an index hash."""
    return manifest.where("coalesce(index_hash, '') != '' and coalesce(collection_name, '') != ''").select(
        "collection_name"
    )


@dataclass(frozen=True)
class ClaimStore:
    spark: SparkSession
    root: str

    def table_dir(self, name: str) -> str:
        return f"{self.root}/index/{name}"

    def write_table(self, name: str, records: DataFrame) -> None:
        records.write.mode("overwrite").options(**PLAIN).parquet(self.table_dir(name), compression="zstd")

    def read_rows(self, name: str) -> DataFrame:
        """The rows as they are stored, without texts that lie in parts."""
        return self.spark.read.parquet(self.table_dir(name))

    def read_table(self, name: str) -> DataFrame:
        rows = self.read_rows(name)
        if "text_part" not in rows.columns:
            return rows
        # one name per build that brought texts of this version
        parts = [row[0] for row in rows.select("text_part").distinct().collect()]
        root = f"{self.root}/texts"
        texts = self.spark.read.option("basePath", root).parquet(*[f"{root}/text_part={part}" for part in parts])
        kept = [c for c in rows.columns if c not in ("claim_id", "text_part")]
        whole = rows.join(texts, ["text_part", "source_text_hash"])
        return whole.select("claim_id", *TEXT_COLUMNS[:2], *kept, *TEXT_COLUMNS[2:])

    def write_texts(self, part: str, texts: DataFrame) -> None:
        """A part: (source_text_hash, the ``TEXT_COLUMNS``), one row per text."""
        out = texts.select("source_text_hash", *TEXT_COLUMNS)
        out.write.options(**PLAIN).parquet(f"{self.root}/texts/text_part={part}", compression="zstd")

    def scan(self, name: str, vectors: bool = False) -> DataFrame:
        """All records; without vectors the scan does not read them."""
        table = self.read_table(name)
        return table if vectors else table.drop("embedding")

    def postings_dir(self, name: str) -> str:
        """Where the keyword index of a table is kept (``operators.postings``)."""
        return f"{self.root}/postings/{name}"

    def count(self, name: str) -> int | None:
        """Row count of a table, from the file footers; None without the table."""
        try:
            return self.read_rows(name).count()
        except AnalysisException:
            return None

    def _append(self, rows: DataFrame, *path: str) -> None:
        rows.write.mode("append").json("/".join([self.root, *path]))

    def _read(self, schema: T.StructType, *path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json("/".join([self.root, *path]))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def activate(self, model_key: str, manifest: DataFrame) -> None:
        self._append(manifest.coalesce(1), "manifests", storage_key(model_key))

    def manifest_log(self, model_key: str) -> DataFrame:
        return self._read(MANIFEST_SCHEMA, "manifests", storage_key(model_key))

    def manifest(self, model_key: str) -> DataFrame:
        """The newest manifest as one row, or no row."""
        return self.manifest_log(model_key).orderBy(F.col("refreshed_at_utc").desc()).limit(1)

    def write_clusters(self, model_key: str, summary: DataFrame) -> None:
        self._append(summary, "clusters", storage_key(model_key))

    def clusters(self, model_key: str) -> DataFrame:
        """Cluster rows of the newest run, if it belongs to the active index."""
        return self._current(CLUSTER_SCHEMA, "clusters", "clustered_at_utc", model_key)

    def write_cluster_map(self, model_key: str, points: DataFrame) -> None:
        self._append(points, "cluster_maps", storage_key(model_key))

    def cluster_map(self, model_key: str) -> DataFrame:
        return self._current(CLUSTER_MAP_SCHEMA, "cluster_maps", "created_at_utc", model_key)

    def _current(self, schema: T.StructType, kind: str, stamp: str, model_key: str) -> DataFrame:
        log = self._read(schema, kind, storage_key(model_key))
        newest = log.agg(F.max(stamp).alias("m")).scalar()
        return matching_artefacts(log.where(F.col(stamp) == newest), self.manifest(model_key))
