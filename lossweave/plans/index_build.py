"""Build or reuse a searchable index version of a claims table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from lossweave.functions.text import described
from lossweave.operators.ingest import dataset_hash, index_hash, kept_counters, one_per_id, prepare_records, row_keys
from lossweave.operators.keyword import with_search_tokens
from lossweave.runtime import broadcast_if_small, write_once
from lossweave.schema import MANIFEST_SCHEMA, ColumnMap
from lossweave.sources.claims import mapped_scan
from lossweave.sources.store import ClaimStore, now_utc, version_name

Embed = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IndexSettings:
    model_key: str
    model_version: str
    model_name: str = ""
    model_path: str = ""
    embedding_version: str = "v1"
    base_name: str = "claims"


@dataclass(frozen=True)
class IndexResult:
    status: str
    collection_name: str
    manifest: Row
    embedded: int | None = None  # texts that were encoded, if vectors of known texts were reused


def _known_texts(store: ClaimStore, name: str) -> DataFrame:
    """(source_text_hash, text_part) of a stored version; the texts of one with whole rows become a part first."""
    rows = store.read_rows(name)
    if "text_part" not in rows.columns:
        part = _new_part(name)
        store.write_texts(part, rows.dropDuplicates(["source_text_hash"]))
        rows = rows.withColumn("text_part", F.lit(part))
    return rows.groupBy("source_text_hash").agg(F.min("text_part").alias("text_part"))


def _new_part(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def _write_shared(
    store: ClaimStore, name: str, rows: DataFrame, records: DataFrame, all_kept: bool, known: DataFrame | None, embed: Embed
) -> int:
    """Write a version whose texts are shared: ``rows`` are its records without texts, ``known`` the stored texts. Each
    other text is encoded once; tells how many those are. Texts are shuffled once, and not at all if none is new."""
    wanted = rows.select("source_text_hash").distinct()
    new = wanted if known is None else wanted.join(known, "source_text_hash", "left_anti")
    new = write_once(new, "new-texts")
    embedded, part = new.count(), _new_part(name)
    if embedded:
        # Never null, so that the join adds no null filter that would hash every text again.
        texts = records.select(F.coalesce("source_text_hash", F.lit("")).alias("source_text_hash"), "document")
        if known is not None or not all_kept:
            texts = texts.join(broadcast_if_small(new), "source_text_hash", "left_semi")
        texts = texts.dropDuplicates(["source_text_hash"]).withColumn("claim_description", described(F.col("document")))
        store.write_texts(part, with_search_tokens(embed(texts)))
    if known is None:
        rows = rows.withColumn("text_part", F.lit(part))
    else:
        joined = rows.join(known, "source_text_hash", "left")
        rows = joined.select(*rows.columns, F.coalesce("text_part", F.lit(part)).alias("text_part"))
    store.write_table(name, rows)
    return embedded


def build_index(
    store: ClaimStore,
    source: DataFrame,
    embed: Embed,
    settings: IndexSettings,
    *,
    source_name: str,
    source_identity: str,
    columns: ColumnMap = ColumnMap(),
    reuse_vectors: bool = False,
) -> IndexResult:
    """``current`` when the active version has this content, ``activated_existing`` when a stored
    version has it, else embed, write and activate (``rebuilt``).

    With ``reuse_vectors`` texts that the active version of the same model and embedding version holds keep their
    vectors, and ``embed`` sees each other text once, as (source_text_hash, document, claim_description); its vector
    must depend on the text alone. Versions then share the texts they have in common. Only the one-row hash and
    counters reach the driver.
    """
    scan = mapped_scan(source, columns)
    records = prepare_records(
        scan,
        columns,
        model_name=settings.model_name or settings.model_key,
        model_path=settings.model_path,
        embedding_version=settings.embedding_version,
    )
    keys = write_once(row_keys(records), "row-keys", "zstd")
    kept = one_per_id(keys)  # an id has one row in an index, as after an upsert
    hashed = index_hash(
        dataset_hash(kept),
        source=source_name,
        source_identity=source_identity,
        selected_columns=columns.selected(),
        model_key=settings.model_key,
        model_fingerprint=settings.model_version,
        embedding_version=settings.embedding_version,
    ).first()
    n_records = hashed["record_count"]
    if n_records == 0:
        raise RuntimeError("The source has no row with both an id and a description, so there is nothing to index.")
    name = version_name(settings.base_name, settings.model_key, hashed["index_hash"])
    active = store.manifest(settings.model_key).first()
    if (
        active is not None
        and active["index_hash"] == hashed["index_hash"]
        and active["collection_name"]
        and store.count(active["collection_name"]) == n_records
    ):
        return IndexResult("current", active["collection_name"], active)

    exists = store.count(name) == n_records
    embedded = None
    if not exists and reuse_vectors:
        same = active is not None and (active["model_fingerprint"], active["embedding_version"]) == (settings.model_version, settings.embedding_version)
        known = None
        if same and store.count(active["collection_name"]):
            known = _known_texts(store, active["collection_name"])
        rows = kept.drop("row_digest", "folded", "tie")
        embedded = _write_shared(store, name, rows, records, keys.count() == n_records, known, embed)
    elif not exists:
        rows = records if keys.count() == n_records else one_per_id(records)
        store.write_table(name, with_search_tokens(embed(rows)))
    manifest = store.spark.createDataFrame(
        [
            (
                now_utc(),
                source_name,
                source_identity,
                name,
                store.root,
                settings.model_key,
                settings.model_name or settings.model_key,
                settings.model_path,
                settings.embedding_version,
                columns.selected(),
                hashed["dataset_hash"],
                settings.model_version,
                hashed["index_hash"],
                kept_counters(scan, keys, columns).first(),
                n_records if exists else store.count(name),
                "activated_existing_index" if exists else "full_rebuild_with_hash_check",
            )
        ],
        MANIFEST_SCHEMA,
    )
    store.activate(settings.model_key, manifest)
    return IndexResult("activated_existing" if exists else "rebuilt", name, manifest.first(), embedded)
