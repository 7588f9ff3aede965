"""CSV and Markdown exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.operators.filters import mentions
from lossweave.operators.profiles import claims_view, report_columns


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV folder with a header per file; quotes inside values are doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def cluster_claims_export(claims: DataFrame, cluster_id: int, search: str = "", view: str = "representative") -> DataFrame:
    """Report columns of one cluster's claims, optionally searched, in the order of a view."""
    chosen = claims.where(F.col("cluster_id") == cluster_id).where(mentions(F.col("document"), search))
    return report_columns(claims_view(chosen, view))


def _money(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.format_string("%.2f", value))


def cluster_reports(overview: DataFrame, summary: DataFrame, financials: DataFrame) -> DataFrame:
    """(cluster_id, report): one Markdown report per cluster."""
    info = summary.select("cluster_id", "frequent_terms", "representative_claims")
    money = financials.select(
        "cluster_id",
        F.struct("total_reserve", "total_paid", "avg_reserve", "largest_reserve").alias("f"),
    )
    rows = overview.join(info, "cluster_id", "left").join(money, "cluster_id", "left")
    words = F.coalesce("frequent_terms", F.array().cast("array<string>"))
    claims = F.coalesce("representative_claims", F.array().cast("array<struct<claim_id:string,description:string>>"))
    lines = F.concat(
        F.array(
            F.concat(F.lit("# Cluster "), F.col("cluster_id").cast("string"), F.lit(" - "), F.col("display_label")),
            F.lit(""),
            F.concat(F.lit("Size: "), F.col("cluster_size").cast("string"), F.lit(" claims")),
            F.concat(F.lit("Review status: "), F.col("review_status")),
            F.lit(""),
            F.lit("## Keywords"),
            F.when(F.size(words) > 0, F.array_join(words, ", ")).otherwise("No keywords available."),
            F.lit(""),
            F.lit("## Representative Claims"),
        ),
        F.transform(claims, lambda c: F.concat(F.lit("- "), c["claim_id"], F.lit(": "), c["description"])),
        F.array(
            F.lit(""),
            F.lit("## Financials"),
            _money("Total reserve", F.col("f.total_reserve")),
            _money("Total paid", F.col("f.total_paid")),
            _money("Average reserve", F.col("f.avg_reserve")),
            _money("Largest reserve", F.col("f.largest_reserve")),
        ),
    )
    return rows.select("cluster_id", F.array_join(lines, "\n").alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Text folder partitioned by cluster."""
    reports.write.mode("overwrite").partitionBy("cluster_id").text(path)
