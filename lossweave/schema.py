"""Column mapping, filter and search settings, and the fixed table schemas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

# Logical fields and the physical column each one has by default.
DEFAULT_COLUMNS = {
    "claim_id": "claim_id",
    "description": "claim_description",
    "line_of_business": "line_of_business",
    "claim_type": "claim_type",
    "cause_of_loss": "cause_of_loss",
    "damaged_object": "damaged_object",
    "country": "country",
    "claim_status": "claim_status",
    "loss_date": "loss_date",
    "reserve_amount": "reserve_amount",
    "paid_amount": "paid_amount",
    "currency": "currency",
    "policy_type": "policy_type",
}
REQUIRED_FIELDS = ("claim_id", "description")
AMOUNT_FIELDS = ("reserve_amount", "paid_amount")

# Labels of the event fields that make up a document, in document order.
DOCUMENT_LABELS = {
    "description": "Claim description",
    "line_of_business": "Line of business",
    "claim_type": "Claim type",
    "cause_of_loss": "Cause of loss",
    "damaged_object": "Damaged object",
    "country": "Country",
}

# The fields that take part in each filter, profile and report.
EQUALITY_FIELDS = (
    "line_of_business",
    "claim_type",
    "cause_of_loss",
    "country",
    "claim_status",
    "policy_type",
    "currency",
    "cluster_id",
)
RANGE_FIELDS = ("loss_year", "reserve_amount", "paid_amount")
IN_LIST_FIELDS = ("line_of_business", "country", "claim_type", "cause_of_loss", "claim_status")
PROFILE_FIELDS = ("line_of_business", "claim_type", "cause_of_loss", "country", "claim_status", "loss_year")
DOMINANT_FIELDS = ("line_of_business", "cause_of_loss", "country")
CLAIM_REPORT_COLUMNS = (
    "claim_id",
    "document",
    "line_of_business",
    "claim_type",
    "cause_of_loss",
    "country",
    "claim_status",
    "loss_year",
    "reserve_amount",
    "paid_amount",
    "currency",
)
REVIEW_STATUSES = ("unreviewed", "accepted", "needs_split", "needs_merge", "too_mixed", "not_useful")
SHORT_DESCRIPTION_CHARS = 20

METADATA_FIELDS = (
    "claim_id",
    "line_of_business",
    "claim_type",
    "cause_of_loss",
    "damaged_object",
    "country",
    "claim_status",
    "loss_date",
    "loss_year",
    "reserve_amount",
    "paid_amount",
    "currency",
    "policy_type",
    "description_length",
    "embedding_model",
    "embedding_model_path",
    "embedding_version",
    "source_text_hash",
)

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("model_key", T.StringType()),
        T.StructField("cluster_version", T.StringType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("manual_label", T.StringType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("updated_at_utc", T.StringType()),
    ]
)

QUALITY_COUNTERS = (
    "source_rows",
    "indexed_rows",
    "missing_descriptions",
    "short_descriptions",
    "duplicate_descriptions",
    "missing_claim_ids",
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("refreshed_at_utc", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_identity", T.StringType()),
        T.StructField("collection_name", T.StringType()),
        T.StructField("store_dir", T.StringType()),
        T.StructField("model_key", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_model_path", T.StringType()),
        T.StructField("embedding_version", T.StringType()),
        T.StructField("selected_columns", T.ArrayType(T.StringType())),
        T.StructField("dataset_hash", T.StringType()),
        T.StructField("model_fingerprint", T.StringType()),
        T.StructField("index_hash", T.StringType()),
        T.StructField(
            "diagnostics", T.StructType([T.StructField(name, T.LongType()) for name in QUALITY_COUNTERS])
        ),
        T.StructField("record_count", T.LongType()),
        T.StructField("refresh_strategy", T.StringType()),
    ]
)

_VALUE_COUNT = T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])
CLUSTER_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField(
            "representative_claims",
            T.ArrayType(
                T.StructType(
                    [T.StructField("claim_id", T.StringType()), T.StructField("description", T.StringType())]
                )
            ),
        ),
        T.StructField("frequent_terms", T.ArrayType(T.StringType())),
        T.StructField("common_metadata", T.MapType(T.StringType(), T.ArrayType(_VALUE_COUNT))),
        T.StructField("n_clusters", T.IntegerType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("random_state", T.IntegerType()),
        T.StructField("clustered_at_utc", T.StringType()),
        T.StructField("index_hash", T.StringType()),
        T.StructField("table_name", T.StringType()),
    ]
)
CLUSTER_MAP_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField(
            "projection",
            T.StructType(
                [
                    T.StructField("method", T.StringType()),
                    T.StructField("metric", T.StringType()),
                    T.StructField("random_state", T.IntegerType()),
                    T.StructField("n_neighbors", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("created_at_utc", T.StringType()),
        T.StructField("index_hash", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ColumnMap:
    """Physical column behind each logical field; a blank name means the field is skipped."""

    claim_id: str = DEFAULT_COLUMNS["claim_id"]
    description: str = DEFAULT_COLUMNS["description"]
    line_of_business: str = DEFAULT_COLUMNS["line_of_business"]
    claim_type: str = DEFAULT_COLUMNS["claim_type"]
    cause_of_loss: str = DEFAULT_COLUMNS["cause_of_loss"]
    damaged_object: str = DEFAULT_COLUMNS["damaged_object"]
    country: str = DEFAULT_COLUMNS["country"]
    claim_status: str = DEFAULT_COLUMNS["claim_status"]
    loss_date: str = DEFAULT_COLUMNS["loss_date"]
    reserve_amount: str = DEFAULT_COLUMNS["reserve_amount"]
    paid_amount: str = DEFAULT_COLUMNS["paid_amount"]
    currency: str = DEFAULT_COLUMNS["currency"]
    policy_type: str = DEFAULT_COLUMNS["policy_type"]

    @classmethod
    def of(cls, mapping: Mapping[str, Any]) -> ColumnMap:
        return cls(**{f.name: str(mapping[f.name]).strip() for f in fields(cls) if f.name in mapping})

    def mapped(self) -> dict[str, str]:
        """Logical name to physical name for every field that is not skipped."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name)}

    def check(self) -> None:
        blank = [name for name in REQUIRED_FIELDS if name not in self.mapped()]
        if blank:
            raise ValueError(f"No source column is given for: {', '.join(blank)}")

    def selected(self) -> list[str]:
        """Physical columns to read, each once, in field order."""
        return list(dict.fromkeys(self.mapped().values()))

    def document_columns(self) -> list[str]:
        mapped = self.mapped()
        return [mapped[name] for name in DOCUMENT_LABELS if name in mapped]


Bounds = tuple[float | None, float | None]
OPEN: Bounds = (None, None)


@dataclass(frozen=True)
class SearchFilters:
    equality: Mapping[str, Any] = field(default_factory=dict)
    loss_year: Bounds = OPEN
    reserve_amount: Bounds = OPEN
    paid_amount: Bounds = OPEN


@dataclass(frozen=True)
class ClusterFilters:
    line_of_business: tuple[str, ...] = ()
    country: tuple[str, ...] = ()
    claim_type: tuple[str, ...] = ()
    cause_of_loss: tuple[str, ...] = ()
    claim_status: tuple[str, ...] = ()
    loss_year: Bounds = OPEN
    reserve_amount: Bounds = OPEN
    paid_amount: Bounds = OPEN
    min_cluster_size: int = 1
    description_search: str = ""
    cluster_search: str = ""
    review_status: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchSpec:
    """Settings of one search run; ``rerank_top_k=None`` takes the size-dependent default."""

    mode: str = "Semantic"
    top_n: int = 10
    candidate_pool: int = 100
    semantic_weight: float = 0.7
    rerank: bool = False
    rerank_top_k: int | None = None
    filters: SearchFilters = field(default_factory=SearchFilters)

    def __post_init__(self) -> None:
        if self.mode not in {"Semantic", "BM25", "Hybrid"}:
            raise ValueError(f"{self.mode!r} is no search mode")

    @property
    def rerank_depth(self) -> int:
        return self.rerank_top_k or min(max(50, self.top_n), self.candidate_pool)
