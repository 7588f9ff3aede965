"""Human cluster reviews as an append-only log with a latest-per-cluster view."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.schema import REVIEW_SCHEMA, REVIEW_STATUSES
from lossweave.sources.store import now_utc

REVIEW_KEYS = ("model_key", "cluster_version", "cluster_id")


def load_review_log(spark: SparkSession, path: str) -> DataFrame:
    """All saved reviews; a missing log is an empty one."""
    try:
        return spark.read.schema(REVIEW_SCHEMA).json(path)
    except AnalysisException:
        return spark.createDataFrame([], REVIEW_SCHEMA)


def current_reviews(log: DataFrame) -> DataFrame:
    """Newest review per model, version and cluster; it replaces all earlier ones."""
    others = [c for c in log.columns if c not in REVIEW_KEYS]
    # The stamp leads the struct, the rest only decides between equal stamps.
    newest = F.max(F.struct("updated_at_utc", *[c for c in others if c != "updated_at_utc"])).alias("r")
    return log.groupBy(*REVIEW_KEYS).agg(newest).select(*[c if c in REVIEW_KEYS else f"r.{c}" for c in log.columns])


def review_history(log: DataFrame) -> DataFrame:
    return log.orderBy(F.col("updated_at_utc").desc(), *REVIEW_KEYS)


def review_rows(
    spark: SparkSession,
    *,
    model_key: str,
    cluster_version: str,
    cluster_id: int,
    manual_label: str,
    review_status: str,
    notes: str,
) -> DataFrame:
    if review_status not in REVIEW_STATUSES:
        raise ValueError(f"{review_status!r} is none of the review statuses")
    row = (model_key, cluster_version, int(cluster_id), manual_label.strip(), review_status, notes.strip(), now_utc())
    return spark.createDataFrame([row], REVIEW_SCHEMA)


def save_review(spark: SparkSession, path: str, **review) -> None:
    review_rows(spark, **review).coalesce(1).write.mode("append").json(path)


def invalid_statuses(log: DataFrame) -> DataFrame:
    """Rows of an imported log whose status is not a known one."""
    return log.where(F.col("review_status").isNull() | ~F.col("review_status").isin(list(REVIEW_STATUSES)))
