"""Predicates over claims and the value domains the filters are chosen from."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions.text import clean_or_null, fold
from lossweave.functions.values import number
from lossweave.schema import EQUALITY_FIELDS, IN_LIST_FIELDS, RANGE_FIELDS, Bounds, ClusterFilters, SearchFilters

NO_FILTER = (None, "", "All")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equality(claims: DataFrame, filters: SearchFilters) -> Column:
    wanted = {f: filters.equality.get(f) for f in EQUALITY_FIELDS if f in claims.columns}
    return _all([F.col(f) == v for f, v in wanted.items() if v not in NO_FILTER])


def in_range(claims: DataFrame, column: str, bounds: Bounds) -> Column:
    """Closed range with open ends. Numeric columns are compared as they are, so the scan can prune on them."""
    low, high = bounds
    if column not in claims.columns or (low is None and high is None):
        return F.lit(True)
    data_type = dict(claims.dtypes)[column]
    value = F.col(column) if data_type in ("int", "bigint", "float", "double") else number(F.col(column))
    checks = [value >= low] if low is not None else []
    checks += [value <= high] if high is not None else []
    if data_type in ("float", "double"):
        checks.append(~F.isnan(value))
    return _all(checks)


def ranges(claims: DataFrame, filters: SearchFilters | ClusterFilters) -> Column:
    return _all([in_range(claims, f, getattr(filters, f)) for f in RANGE_FIELDS])


def search_filter(claims: DataFrame, filters: SearchFilters) -> DataFrame:
    return claims.where(equality(claims, filters) & ranges(claims, filters))


def in_lists(claims: DataFrame, filters: ClusterFilters) -> Column:
    chosen = {f: list(getattr(filters, f)) for f in IN_LIST_FIELDS if f in claims.columns}
    return _all([F.col(f).isin(values) for f, values in chosen.items() if values])


def mentions(text: Column, query: str) -> Column:
    """Caseless literal substring test."""
    return F.contains(fold(F.coalesce(text, F.lit(""))), fold(F.lit(query))) if query else F.lit(True)


def cluster_claims_filter(claims: DataFrame, filters: ClusterFilters) -> DataFrame:
    keep = in_lists(claims, filters) & ranges(claims, filters)
    return claims.where(keep & mentions(F.col("document"), filters.description_search))


def overview_filter(overview: DataFrame, filters: ClusterFilters) -> DataFrame:
    """Minimum size, label or keyword search, and review status of clusters."""
    searched = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("cluster_label", "manual_label", "top_keywords")])
    kept = overview.where(F.col("cluster_size") >= filters.min_cluster_size)
    kept = kept.where(mentions(searched, filters.cluster_search))
    return kept.where(F.col("review_status").isin(list(filters.review_status))) if filters.review_status else kept


def vocabulary(claims: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Sorted distinct non-blank values per field, all fields in one pass."""
    present = [f for f in fields if f in claims.columns]
    long = claims.select(*[F.col(f).cast("string").alias(f) for f in present]).unpivot([], present, "field", "value")
    values = long.select("field", clean_or_null(F.col("value")).alias("value")).where("value is not null")
    return values.distinct().orderBy("field", "value")


def range_domains(claims: DataFrame, fields: Iterable[str] = RANGE_FIELDS) -> DataFrame:
    """Lowest and highest number per field; fields without a spread have no domain."""
    present = [f for f in fields if f in claims.columns]
    long = claims.select(*[number(F.col(f)).alias(f) for f in present]).unpivot([], present, "field", "value")
    whole = F.col("field") == "loss_year"
    domain = long.groupBy("field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return domain.where("low < high").select(
        "field",
        F.when(whole, F.floor("low").cast("double")).otherwise(F.col("low")).alias("low"),
        F.when(whole, F.floor("high").cast("double")).otherwise(F.col("high")).alias("high"),
    )
