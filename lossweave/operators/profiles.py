"""Roll-ups, financials, filters, outliers and views over clustered claims."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions import values as vl
from lossweave.functions.text import clean_or_null, clean_text
from lossweave.operators.clusters import value_counts
from lossweave.operators.filters import cluster_claims_filter, overview_filter
from lossweave.operators.quantile import exact_quantile
from lossweave.runtime import broadcast_if_small
from lossweave.schema import CLAIM_REPORT_COLUMNS, DOMINANT_FIELDS, ClusterFilters

OVERVIEW_TERMS = 6
OUTLIERS_SHOWN = 50
TOP_CLUSTERS = 20

# Reasons of unusual claims, strongest first, and the length below which a text says little.
HIGH_SEVERITY = "High severity claim"
LOW_INFORMATION = "Low-information description"
SINGLETON = "Singleton cluster"
LOW_INFORMATION_CHARS = 40
SEVERITY_QUANTILE = 0.9

# Columns of the overview table and the measures it rounds to four decimals.
OVERVIEW_COLUMNS = (
    "cluster_id",
    "display_label",
    "manual_label",
    "cluster_size",
    "top_keywords",
    "dominant_line_of_business",
    "dominant_cause_of_loss",
    "dominant_country",
    "total_reserve",
    "total_paid",
    "avg_reserve",
    "outlier_share",
    "review_status",
)
ROUNDED = ("total_reserve", "total_paid", "avg_reserve", "outlier_share")


def _amount(claims: DataFrame, name: str) -> Column:
    return vl.amount(F.col(name)) if name in claims.columns else F.lit(0.0)


def dominant_values(claims: DataFrame, fields: Iterable[str] = DOMINANT_FIELDS) -> DataFrame:
    """(cluster_id, dominant_<field>...): most frequent value per cluster, smallest value on ties."""
    fields = list(fields)
    counts = value_counts(claims, fields, ["cluster_id"])
    best = counts.groupBy("cluster_id", "field").agg(F.min(F.struct(-F.col("count"), "value"))["value"].alias("value"))
    picks = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"dominant_{f}") for f in fields]
    return best.groupBy("cluster_id").agg(*picks)


def cluster_measures(claims: DataFrame) -> DataFrame:
    """Size, amounts and dominant values per cluster; missing amounts count as zero."""
    member = claims.where("cluster_id is not null")
    reserve, paid = _amount(member, "reserve_amount"), _amount(member, "paid_amount")
    sums = member.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"),
        F.sum(reserve).alias("total_reserve"),
        F.sum(paid).alias("total_paid"),
        F.avg(reserve).alias("avg_reserve"),
        F.avg(paid).alias("avg_paid"),
    )
    alone = F.when(F.col("cluster_size") == 1, 1).otherwise(0)
    joined = sums.join(dominant_values(member), "cluster_id", "left")
    return joined.select(
        "cluster_id",
        "cluster_size",
        *[F.coalesce(f"dominant_{f}", F.lit("")).alias(f"dominant_{f}") for f in DOMINANT_FIELDS],
        "total_reserve",
        "total_paid",
        "avg_reserve",
        "avg_paid",
        alone.alias("outlier_count"),
        (alone / F.col("cluster_size")).alias("outlier_share"),
    )


def cluster_overview(
    claims: DataFrame, summary: DataFrame, reviews: DataFrame, model_key: str, version: str
) -> DataFrame:
    """One row per cluster: measures, label, keywords and current review, largest cluster first.

    ``summary`` has cluster_id, label and frequent_terms; ``reviews`` one row per reviewed cluster.
    """
    info = summary.select("cluster_id", F.col("label").alias("info_label"), "frequent_terms")
    mine = reviews.where((F.col("model_key") == model_key) & (F.col("cluster_version") == version)).select(
        "cluster_id", F.col("manual_label").alias("review_label"), F.col("review_status").alias("status"), "notes"
    )
    rows = cluster_measures(claims).join(info, "cluster_id", "left").join(mine, "cluster_id", "left")
    plain = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    words = F.slice(F.coalesce("frequent_terms", F.array().cast("array<string>")), 1, OVERVIEW_TERMS)
    return rows.select(
        "cluster_id",
        F.coalesce(clean_or_null(F.col("info_label")), plain).alias("cluster_label"),
        clean_text(F.col("review_label")).alias("manual_label"),
        "cluster_size",
        F.array_join(words, ", ").alias("top_keywords"),
        *[f"dominant_{f}" for f in DOMINANT_FIELDS],
        "total_reserve",
        "total_paid",
        "avg_reserve",
        "avg_paid",
        "outlier_count",
        "outlier_share",
        F.coalesce(clean_or_null(F.col("status")), F.lit("unreviewed")).alias("review_status"),
        clean_text(F.col("notes")).alias("review_notes"),
        vl.display_label(F.col("review_label"), F.col("info_label"), F.col("cluster_id")).alias("display_label"),
    ).orderBy(F.col("cluster_size").desc(), "cluster_id")


def filtered_overview(claims: DataFrame, overview: DataFrame) -> DataFrame:
    """Measures recomputed over the given claims; labels, keywords and reviews carried over."""
    fresh = cluster_measures(claims)
    carried = overview.select("cluster_id", *[c for c in overview.columns if c not in fresh.columns])
    return fresh.join(carried, "cluster_id").select(*overview.columns)


def filter_clusters(
    claims: DataFrame, overview: DataFrame, filters: ClusterFilters = ClusterFilters()
) -> tuple[DataFrame, DataFrame]:
    """Claims and overview after row filters, recomputation and cluster filters."""
    kept = cluster_claims_filter(claims, filters)
    clusters = overview_filter(filtered_overview(kept, overview), filters)
    surviving = kept.join(broadcast_if_small(clusters.select("cluster_id")), "cluster_id", "left_semi")
    return surviving, clusters.orderBy(F.col("cluster_size").desc(), "cluster_id")


def cluster_financials(claims: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Sums, averages, exact median and maximum of the amounts, per key or overall."""
    keys = list(keys)
    reserve, paid = _amount(claims, "reserve_amount"), _amount(claims, "paid_amount")
    zero = F.lit(0.0)
    sums = claims.groupBy(*keys).agg(
        F.coalesce(F.sum(reserve), zero).alias("total_reserve"),
        F.coalesce(F.sum(paid), zero).alias("total_paid"),
        F.coalesce(F.avg(reserve), zero).alias("avg_reserve"),
        F.coalesce(F.avg(paid), zero).alias("avg_paid"),
        F.coalesce(F.max(reserve), zero).alias("largest_reserve"),
    )
    median = exact_quantile(claims, keys, reserve, 0.5, "median_reserve")
    if not keys:
        return sums.withColumn("median_reserve", F.coalesce(median.scalar(), zero))
    return sums.join(median, keys, "left").withColumn("median_reserve", F.coalesce("median_reserve", zero))


def with_cluster_size(claims: DataFrame, overview: DataFrame) -> DataFrame:
    sizes = broadcast_if_small(overview.select("cluster_id", "cluster_size"))
    joined = claims.join(sizes, "cluster_id", "left")
    return joined.withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0)))


def unusual_claims(claims: DataFrame, overview: DataFrame, limit: int = OUTLIERS_SHOWN) -> DataFrame:
    """Claims worth a second look with the strongest reason, largest reserve first."""
    reserve = _amount(claims, "reserve_amount")
    threshold = exact_quantile(claims, [], reserve, SEVERITY_QUANTILE, "threshold").scalar()
    size = vl.number(F.col("description_length"))
    reason = (
        F.when((F.col("reserve_value") >= F.col("threshold")) & (F.col("reserve_value") > 0), HIGH_SEVERITY)
        .when((size > 0) & (size < LOW_INFORMATION_CHARS), LOW_INFORMATION)
        .when(F.col("cluster_size") <= 1, SINGLETON)
    )
    rows = with_cluster_size(claims, overview).withColumn("reserve_value", reserve).withColumn("threshold", threshold)
    flagged = rows.withColumn("outlier_reason", reason).where("outlier_reason is not null")
    flagged = flagged.withColumn("reserve_amount", F.col("reserve_value")).drop("reserve_value", "threshold")
    return flagged.orderBy(F.col("reserve_amount").desc(), "claim_id").limit(limit)


def status_distribution(claims: DataFrame) -> DataFrame:
    status = F.coalesce("claim_status", F.lit(vl.UNKNOWN))
    counts = claims.groupBy(status.alias("claim_status")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), "claim_status")


def claims_over_time(claims: DataFrame) -> DataFrame:
    rows = claims.where("loss_year is not null and cluster_id is not null")
    return rows.groupBy("loss_year", "cluster_id").agg(F.count("*").alias("count"))


def overview_totals(claims: DataFrame, overview: DataFrame, reviews: DataFrame, model_key: str, version: str) -> DataFrame:
    """One row of headline numbers. Reviews are those of the cluster version, filtered or not."""
    mine = reviews.where((F.col("model_key") == model_key) & (F.col("cluster_version") == version))
    shown = claims.agg(F.count("*").alias("n")).scalar()
    reviewed = mine.agg(F.count("*").alias("n")).scalar()
    return overview.agg(
        F.count_distinct("cluster_id").alias("clusters"),
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("outliers"),
        F.max("cluster_size").alias("largest_cluster"),
        F.coalesce(F.sum("total_reserve"), F.lit(0.0)).alias("total_reserve"),
    ).select(
        shown.alias("claims_shown"),
        "*",
        F.concat_ws("/", reviewed.cast("string"), F.col("clusters").cast("string")).alias("reviewed"),
    )


def index_profile(records: DataFrame) -> DataFrame:
    """One row: record count, filled metadata columns, mean description length, number of clusters."""
    names = sorted(c for c in records.columns if c not in ("document", "claim_description", "embedding"))
    clusters = F.count_distinct("cluster_id") if "cluster_id" in records.columns else F.lit(0).cast("long")
    row = records.agg(
        F.count("*").alias("record_count"),
        F.coalesce(F.bround(F.avg(vl.number(F.col("description_length"))), 1), F.lit(0.0)).alias(
            "average_description_length"
        ),
        clusters.alias("cluster_count"),
        *[F.count(n).alias(f"n_{n}") for n in names],
    )
    filled = F.array_compact(F.array(*[F.when(F.col(f"n_{n}") > 0, n) for n in names]))
    return row.select("record_count", filled.alias("metadata_columns"), "average_description_length", "cluster_count")


def top_clusters(overview: DataFrame, measure: str, n: int = TOP_CLUSTERS) -> DataFrame:
    return overview.orderBy(F.col(measure).desc(), "cluster_id").limit(n).select("cluster_id", measure)


def overview_table(overview: DataFrame) -> DataFrame:
    """Overview columns for display, measures rounded half-even to four decimals."""
    present = [c for c in OVERVIEW_COLUMNS if c in overview.columns]
    return overview.select(*[F.bround(c, 4).alias(c) if c in ROUNDED else F.col(c) for c in present])


def report_columns(claims: DataFrame) -> DataFrame:
    return claims.select(*[c for c in CLAIM_REPORT_COLUMNS if c in claims.columns])


def claims_view(claims: DataFrame, view: str = "representative") -> DataFrame:
    """Claims of a cluster in one of four orders, ids on ties; a limit after it takes the top only."""
    orders = {
        "representative": [],
        "largest": [F.col("reserve_amount").desc_nulls_last()],
        "newest": [F.col("loss_date").desc_nulls_last()],
        "weakest": [F.col("description_length").asc_nulls_last()],
    }
    return claims.orderBy(*orders[view], "claim_id")


def map_view(points: DataFrame, claims: DataFrame, overview: DataFrame, selected: int) -> DataFrame:
    """Map points of the given claims with label, selection flag, reserve bucket and snippet."""
    place = points.select("claim_id", "x", "y", "description")
    labels = broadcast_if_small(overview.select("cluster_id", F.col("display_label").alias("cluster_label")))
    joined = place.join(claims, "claim_id").join(labels, "cluster_id", "left")
    return (
        joined.withColumn("cluster_label", F.coalesce("cluster_label", F.lit(vl.UNKNOWN)))
        .withColumn("selected_cluster", vl.selected_flag(F.col("cluster_id"), selected))
        .withColumn("reserve_bucket", vl.reserve_bucket(F.col("reserve_amount")))
        .withColumn("short_description", vl.snippet(F.col("description")))
    )
