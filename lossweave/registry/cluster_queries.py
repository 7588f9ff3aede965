"""Cluster building and roll-ups over the claims that carry a given cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossweave.functions.stopwords import STOP_WORDS
from lossweave.functions.values import number
from lossweave.operators import clusters as cl, filters as fl, profiles as pr, quantized as qz, semantic as sem
from lossweave.operators.quantile import exact_quantile
from lossweave.registry.base import (
    REVIEW_SQL,
    clean_sql,
    index_claims,
    index_sql,
    keywords_sql,
    records,
    register,
    review_log,
    table,
)
from lossweave.runtime import pin_small, shared_dir, write_once
from lossweave.schema import DOMINANT_FIELDS, PROFILE_FIELDS, ClusterFilters
from lossweave.sources.exports import cluster_reports
from lossweave.sources.reviews import current_reviews

C = F.col
MODEL, CLUSTER_VERSION = "model-a", "1-URGENT"
AMOUNTS = ("reserve_amount", "paid_amount")
FILTERS = ClusterFilters(
    country=("de", "en"),
    claim_status=("F", "O"),
    loss_year=(1995, 1999),
    reserve_amount=(10_000.0, None),
    min_cluster_size=8,
    description_search="ER",
    cluster_search="Label",
    review_status=("accepted", "needs_split", "needs_merge", "too_mixed", "unreviewed"),
)


def clustered(spark, d, fields=None):
    claims = index_claims(spark, d) if fields is None else index_claims(spark, d, fields)
    return claims.where("cluster_id is not null")


def overview(spark, d, claims=None):
    claims = clustered(spark, d) if claims is None else claims
    reviews = current_reviews(review_log(spark, d))
    return pr.cluster_overview(claims, cl.cluster_summary(claims), reviews, MODEL, CLUSTER_VERSION)


def stored_overview(spark, d, claims=None):
    """The overview as a finished small table, like the explorer reads it."""
    return pin_small(overview(spark, d, claims))[0]


# --- SQL ----------------------------------------------------------------------------------

CLUSTERED_SQL = "cc AS (SELECT * FROM idx WHERE cluster_id IS NOT NULL)"
UNIT_SQL = (
    "un AS (SELECT claim_id, cluster_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u "
    "FROM (SELECT claim_id, cluster_id, CAST(embedding AS DOUBLE[]) AS e FROM idx WHERE embedding IS NOT NULL AND cluster_id IS NOT NULL))"
)
CENTROID_SQL = (
    UNIT_SQL,
    "cm AS (SELECT cluster_id, pos, avg(x) AS x FROM (SELECT cluster_id, unnest(u) AS x, unnest(range(len(u))) AS pos FROM un) GROUP BY ALL)",
    "ce AS (SELECT cluster_id, list(x ORDER BY pos) AS centroid FROM cm GROUP BY 1)",
)
KEYWORD_SQL = (
    "kw AS (SELECT claim_id, cluster_id, "
    + keywords_sql(
        "concat_ws(' ', claim_description, coalesce(claim_type, ''), coalesce(cause_of_loss, ''), coalesce(damaged_object, ''))",
        STOP_WORDS,
    )
    + " AS toks FROM cc)",
    "kd AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM kw) GROUP BY 1)",
    "kc AS (SELECT cluster_id, term, count(*) AS term_count FROM (SELECT cluster_id, unnest(toks) AS term FROM kw) GROUP BY ALL)",
    "ks AS (SELECT cluster_id, term, term_count, df, round(term_count * (ln((1 + (SELECT count(*) FROM cc)) / (1.0 + df)) + 1), 9) AS score "
    "FROM kc JOIN kd USING (term))",
    "kt AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS rank FROM ks QUALIFY rank <= 10)",
    "kl AS (SELECT cluster_id, list(term ORDER BY rank) AS terms FROM kt GROUP BY 1)",
)
REP_SQL = (
    *CENTROID_SQL,
    "rp AS (SELECT claim_id, un.cluster_id, round(list_cosine_distance(u, centroid), 12) + 0.0 AS distance, "
    "row_number() OVER (PARTITION BY un.cluster_id ORDER BY round(list_cosine_distance(u, centroid), 12), claim_id) AS rank "
    "FROM un JOIN ce ON un.cluster_id = ce.cluster_id QUALIFY rank <= 3)",
)


def _long_sql(fields, source="cc"):
    return " UNION ALL ".join(
        f"SELECT cluster_id, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM {source} WHERE {f} IS NOT NULL" for f in fields
    )


def measures_sql(source: str = "cc", prefix: str = "me") -> tuple[str, ...]:
    dominant = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS dominant_{f}" for f in DOMINANT_FIELDS)
    return (
        f"{prefix}_dv AS (SELECT cluster_id, field, value FROM (SELECT cluster_id, field, value, count(*) AS c FROM "
        f"({_long_sql(DOMINANT_FIELDS, source)}) GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY cluster_id, field ORDER BY c DESC, value) = 1)",
        f"{prefix}_dm AS (SELECT cluster_id, {dominant} FROM {prefix}_dv GROUP BY 1)",
        f"{prefix} AS (SELECT m.*, dominant_line_of_business, dominant_cause_of_loss, dominant_country FROM (SELECT cluster_id, "
        "count(*) AS cluster_size, sum(coalesce(reserve_amount, 0)) AS total_reserve, sum(coalesce(paid_amount, 0)) AS total_paid, "
        "avg(coalesce(reserve_amount, 0)) AS avg_reserve, avg(coalesce(paid_amount, 0)) AS avg_paid, "
        f"CAST(CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS INTEGER) AS outlier_count FROM {source} GROUP BY 1) m "
        f"LEFT JOIN {prefix}_dm d ON d.cluster_id = m.cluster_id)",
    )


LABEL_SQL = (
    "lb AS (SELECT cluster_id, terms, array_to_string(list_transform(string_split(array_to_string(terms[1:3], ' / '), '-'), "
    "lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')), '-') AS label FROM kl)"
)
CURRENT_SQL = (
    REVIEW_SQL,
    "cr AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY model_key, cluster_version, cluster_id "
    "ORDER BY updated_at_utc DESC) = 1)",
)
OVERVIEW_SQL = (
    CLUSTERED_SQL,
    *KEYWORD_SQL,
    LABEL_SQL,
    *CURRENT_SQL,
    *measures_sql(),
    "ov AS (SELECT me.*, outlier_count * 1.0 / cluster_size AS outlier_share, coalesce(label, 'Cluster ' || me.cluster_id) AS cluster_label, "
    "coalesce(trim(manual_label), '') AS manual_label, array_to_string(terms[1:6], ', ') AS top_keywords, "
    "coalesce(review_status, 'unreviewed') AS review_status, coalesce(notes, '') AS review_notes, "
    "coalesce(nullif(trim(manual_label), ''), label, 'Cluster ' || me.cluster_id) AS display_label "
    "FROM me LEFT JOIN lb ON lb.cluster_id = me.cluster_id "
    f"LEFT JOIN (SELECT * FROM cr WHERE model_key = '{MODEL}' AND cluster_version = '{CLUSTER_VERSION}') r "
    "ON r.cluster_id = me.cluster_id)",
)
OVERVIEW_LIST = (
    "cluster_id, cluster_label, manual_label, cluster_size, top_keywords, dominant_line_of_business, dominant_cause_of_loss, "
    "dominant_country, round(total_reserve, 4) AS total_reserve, round(total_paid, 4) AS total_paid, "
    "round(avg_reserve, 6) AS avg_reserve, round(avg_paid, 6) AS avg_paid, outlier_count, CAST(outlier_share AS DOUBLE) AS outlier_share, "
    "review_status, review_notes, display_label"
)
FILTERED_SQL = (
    *OVERVIEW_SQL,
    "fc AS (SELECT * FROM cc WHERE country IN ('de', 'en') AND claim_status IN ('F', 'O') AND loss_year BETWEEN 1995 AND 1999 "
    "AND reserve_amount >= 10000 AND contains(replace(lower(document), 'ß', 'ss'), 'er'))",
    *measures_sql("fc", "fm"),
    "fo AS (SELECT fm.*, fm.outlier_count * 1.0 / fm.cluster_size AS outlier_share, cluster_label, manual_label, top_keywords, "
    "review_status, review_notes, display_label FROM fm JOIN ov ON ov.cluster_id = fm.cluster_id "
    "WHERE fm.cluster_size >= 8 AND contains(replace(lower(cluster_label || ' ' || manual_label || ' ' || top_keywords), 'ß', 'ss'), 'label') "
    "AND review_status IN ('accepted', 'needs_split', 'needs_merge', 'too_mixed', 'unreviewed'))",
)
THRESHOLD_SQL = "(SELECT quantile_cont(coalesce(reserve_amount, 0), 0.9) FROM cc)"
OUTLIER_SQL = (
    CLUSTERED_SQL,
    "sz AS (SELECT cluster_id, count(*) AS cluster_size FROM cc GROUP BY 1)",
    f"ou AS (SELECT claim_id, cc.cluster_id, cluster_size, coalesce(reserve_amount, 0) AS reserve_amount, CASE "
    f"WHEN coalesce(reserve_amount, 0) >= {THRESHOLD_SQL} AND coalesce(reserve_amount, 0) > 0 THEN 'High severity claim' "
    "WHEN description_length BETWEEN 1 AND 39 THEN 'Low-information description' "
    "WHEN cluster_size <= 1 THEN 'Singleton cluster' END AS outlier_reason FROM cc LEFT JOIN sz ON sz.cluster_id = cc.cluster_id)",
)


def _plain_overview(claims):
    """Roll-up without text work, for the operators that only need sizes and amounts."""
    spark = claims.sparkSession
    return pr.cluster_measures(claims).withColumn(
        "display_label", F.concat(F.lit("Cluster "), C("cluster_id").cast("string"))
    )


# --- clusters -----------------------------------------------------------------------------


@register("A17_centroids", index_sql(
    "SELECT cluster_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)), 6) + 0.0 AS x "
    "FROM (SELECT cluster_id, CAST(pos AS INTEGER) AS pos, x FROM cm)", *CENTROID_SQL))
def a17(spark, d):
    rows = cl.centroids(clustered(spark, d, ()))
    return rows.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select(
        "cluster_id", "pos", (F.round("x", 6) + 0.0).alias("x")
    )


@register("W1_J11_representatives", index_sql(
    "SELECT cluster_id, claim_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM rp", *REP_SQL))
def w1(spark, d):
    claims = clustered(spark, d, ())
    return cl.representatives(claims, cl.centroids(claims)).withColumn("distance", F.round("distance", 6))


@register("M12_nearest_centroid", index_sql(
    "SELECT claim_id, cluster_id, round(distance, 6) AS distance FROM (SELECT claim_id, ce.cluster_id, "
    "round(list_cosine_distance(u, centroid), 12) + 0.0 AS distance FROM un, ce) "
    "QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY distance, cluster_id) = 1", *CENTROID_SQL))
def m12(spark, d):
    claims = clustered(spark, d, ())
    return sem.assign_nearest(claims, cl.centroids(claims)).withColumn("distance", F.round("distance", 6))


@register("A9_W2_cluster_keywords", index_sql(
    "SELECT cluster_id, term, term_count, CAST(df AS BIGINT) AS df, score, CAST(rank AS INTEGER) AS rank FROM kt",
    CLUSTERED_SQL, *KEYWORD_SQL))
def a9(spark, d):
    return cl.cluster_terms(clustered(spark, d))


@register("A8_W3_top_values", index_sql(
    "SELECT cluster_id, field, value, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY cluster_id, field ORDER BY count DESC, value) AS rank FROM (SELECT cluster_id, field, value, count(*) AS count "
    f"FROM ({_long_sql(PROFILE_FIELDS)}) GROUP BY ALL)) WHERE rank <= 5", CLUSTERED_SQL))
def a8(spark, d):
    return cl.top_values(cl.value_counts(clustered(spark, d), keys=["cluster_id"]), ["cluster_id"])


@register("A8_common_values", index_sql(
    "SELECT field, string_agg(value || '=' || count, ', ' ORDER BY count DESC, value) AS common FROM (SELECT field, value, count(*) AS count "
    f"FROM ({_long_sql(PROFILE_FIELDS, 'idx')}) GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, value) <= 5) GROUP BY 1"))
def a8_global(spark, d):
    rows = cl.common_values(records(spark, d), keep_empty=True).select(F.explode("common_metadata").alias("field", "l"))
    return rows.select(
        "field",
        F.array_join(F.transform("l", lambda e: F.concat_ws("=", e["value"], e["count"].cast("string"))), ", ").alias("common"),
    )


@register("M13_cluster_summary", index_sql(
    "SELECT lb.cluster_id, label, size, array_to_string(terms, ' ') AS terms, reps, common FROM lb "
    "JOIN (SELECT cluster_id, count(*) AS size FROM cc GROUP BY 1) s ON s.cluster_id = lb.cluster_id "
    "JOIN (SELECT rp.cluster_id, string_agg(rp.claim_id || ': ' || claim_description, '; ' ORDER BY rank) AS reps FROM rp "
    "JOIN idx ON idx.claim_id = rp.claim_id GROUP BY 1) r ON r.cluster_id = lb.cluster_id "
    "JOIN (SELECT cluster_id, string_agg(field || '=' || value || ' ' || c, '; ' ORDER BY field, c DESC, value) AS common FROM "
    f"(SELECT cluster_id, field, value, count(*) AS c FROM ({_long_sql(PROFILE_FIELDS)}) GROUP BY cluster_id, field, value "
    "QUALIFY row_number() OVER (PARTITION BY cluster_id, field ORDER BY c DESC, value) <= 5) GROUP BY 1) v ON v.cluster_id = lb.cluster_id",
    CLUSTERED_SQL, *KEYWORD_SQL, LABEL_SQL, *REP_SQL))
def m13(spark, d):
    rows = cl.cluster_summary(clustered(spark, d))
    values = F.flatten(
        F.transform(
            F.array_sort(F.map_keys("common_metadata")),
            lambda f: F.transform(
                F.element_at("common_metadata", f),
                lambda e: F.concat(f, F.lit("="), e["value"], F.lit(" "), e["count"].cast("string")),
            ),
        )
    )
    reps = F.transform("representative_claims", lambda r: F.concat(r["claim_id"], F.lit(": "), r["description"]))
    return rows.select(
        "cluster_id",
        "label",
        "size",
        F.array_join("frequent_terms", " ").alias("terms"),
        F.array_join(reps, "; ").alias("reps"),
        F.array_join(values, "; ").alias("common"),
    )


@register("M11_kmeans")
def m11(spark, d):
    labelled, centres = cl.cluster_claims(index_claims(spark, d, ()), 12)
    return labelled.where("cluster_id is not null").select("claim_id", "cluster_id").join(centres, "cluster_id", "left")


@register("M14_cluster_map")
def m14(spark, d):
    return cl.cluster_map(clustered(spark, d))


# --- roll-ups -----------------------------------------------------------------------------


@register("A4_J2_T4_cluster_overview", index_sql(f"SELECT {OVERVIEW_LIST} FROM ov", *OVERVIEW_SQL))
def a4(spark, d):
    return _shown(overview(spark, d))


def _shown(rows):
    return rows.withColumns({
        "total_reserve": F.round("total_reserve", 4),
        "total_paid": F.round("total_paid", 4),
        "avg_reserve": F.round("avg_reserve", 6),
        "avg_paid": F.round("avg_paid", 6),
    })


@register("A5_F7_F8_J7_filtered_overview", index_sql(f"SELECT {OVERVIEW_LIST} FROM fo", *FILTERED_SQL))
def a5(spark, d):
    claims = clustered(spark, d)
    return _shown(pr.filter_clusters(claims, stored_overview(spark, d, claims), FILTERS)[1])


@register("M16_J6_F4_F5_filtered_claims", index_sql(
    "SELECT claim_id, cluster_id FROM fc WHERE cluster_id IN (SELECT cluster_id FROM fo)", *FILTERED_SQL))
def m16(spark, d):
    claims = clustered(spark, d)
    return pr.filter_clusters(claims, stored_overview(spark, d, claims), FILTERS)[0].select("claim_id", "cluster_id")


@register("F4_in_lists", index_sql(
    "SELECT claim_id FROM idx WHERE country IN ('de', 'en') AND claim_status IN ('F', 'O')"))
def f4(spark, d):
    claims = records(spark, d, ("country", "claim_status"))
    return claims.where(fl.in_lists(claims, ClusterFilters(country=("de", "en"), claim_status=("F", "O")))).select("claim_id")


@register("F5_description_search", index_sql(
    "SELECT claim_id FROM idx WHERE contains(replace(lower(document), 'ß', 'ss'), 'ssen')"))
def f5(spark, d):
    return records(spark, d, ()).where(fl.mentions(C("document"), "ßEN")).select("claim_id")


@register("F6_cluster_search", index_sql(
    "SELECT cluster_id FROM ov WHERE contains(lower(cluster_label || ' ' || manual_label || ' ' || top_keywords), 'label')", *OVERVIEW_SQL))
def f6(spark, d):
    return fl.overview_filter(stored_overview(spark, d), ClusterFilters(cluster_search="LABEL")).select("cluster_id")


@register("P22_overview_table", index_sql(
    "SELECT cluster_id, display_label, manual_label, cluster_size, top_keywords, dominant_line_of_business, dominant_cause_of_loss, "
    "dominant_country, round(total_reserve, 4) AS total_reserve, round(total_paid, 4) AS total_paid, round_even(avg_reserve, 4) AS avg_reserve, "
    "CAST(outlier_share AS DOUBLE) AS outlier_share, review_status FROM ov", *OVERVIEW_SQL))
def p22(spark, d):
    return pr.overview_table(overview(spark, d))


@register("A6_cluster_financials", index_sql(
    "SELECT cluster_id, round(sum(r), 4) AS total_reserve, round(sum(p), 4) AS total_paid, round(avg(r), 6) AS avg_reserve, "
    "round(avg(p), 6) AS avg_paid, max(r) AS largest_reserve, round(quantile_cont(r, 0.5), 6) AS median_reserve FROM "
    "(SELECT cluster_id, coalesce(reserve_amount, 0) AS r, coalesce(paid_amount, 0) AS p FROM cc) GROUP BY 1", CLUSTERED_SQL))
def a6(spark, d):
    rows = pr.cluster_financials(clustered(spark, d, AMOUNTS), ["cluster_id"])
    return _shown(rows).withColumn("median_reserve", F.round("median_reserve", 6))


@register("A7_dominant_values", index_sql(
    "SELECT cluster_id, dominant_line_of_business, dominant_cause_of_loss, dominant_country FROM me", CLUSTERED_SQL, *measures_sql()))
def a7(spark, d):
    return pr.dominant_values(clustered(spark, d))


@register("A10_index_profile", index_sql(
    "SELECT count(*) AS record_count, 'cause_of_loss claim_id claim_status claim_type cluster_id country currency damaged_object "
    "description_length embedding_model embedding_model_path embedding_version line_of_business loss_date loss_year paid_amount "
    "policy_type reserve_amount source_text_hash' AS metadata_columns, round_even(avg(description_length), 1) AS average_description_length, "
    "count(DISTINCT cluster_id) AS cluster_count FROM idx"))
def a10(spark, d):
    row = pr.index_profile(index_claims(spark, d))
    return row.withColumn("metadata_columns", F.array_join("metadata_columns", " "))


@register("A13_status_distribution",
          "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE o_orderstatus END AS claim_status, count(*) AS count FROM orders GROUP BY 1")
def a13(spark, d):
    rows = table(spark, d, "orders").select(F.when(C("o_orderkey") % 7 != 0, C("o_orderstatus")).alias("claim_status"))
    return pr.status_distribution(rows)


@register("A14_claims_over_time", index_sql(
    "SELECT loss_year, cluster_id, count(*) AS count FROM cc WHERE loss_year IS NOT NULL GROUP BY ALL", CLUSTERED_SQL))
def a14(spark, d):
    return pr.claims_over_time(index_claims(spark, d, ("loss_date",)))


@register("A15_overview_totals", index_sql(
    "SELECT (SELECT count(*) FROM fc WHERE cluster_id IN (SELECT cluster_id FROM fo)) AS claims_shown, count(DISTINCT cluster_id) AS clusters, "
    "CAST(sum(outlier_count) AS BIGINT) AS outliers, max(cluster_size) AS largest_cluster, round(sum(total_reserve), 4) AS total_reserve, "
    f"(SELECT count(*) FROM cr WHERE model_key = '{MODEL}' AND cluster_version = '{CLUSTER_VERSION}') || '/' || count(*) AS reviewed FROM fo",
    *FILTERED_SQL))
def a15(spark, d):
    claims = clustered(spark, d)
    reviews = current_reviews(review_log(spark, d))
    kept, clusters = pr.filter_clusters(claims, stored_overview(spark, d, claims), FILTERS)
    return pr.overview_totals(kept, clusters, reviews, MODEL, CLUSTER_VERSION).withColumn(
        "total_reserve", F.round("total_reserve", 4)
    )


@register("A16_severity_threshold", "SELECT round(quantile_cont(o_totalprice, 0.9), 6) AS threshold FROM orders")
def a16(spark, d):
    rows = exact_quantile(table(spark, d, "orders"), [], number(C("o_totalprice")), 0.9, "threshold")
    return rows.select(F.round("threshold", 6).alias("threshold"))


@register("A16_quantile_per_key",
          "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.37), 6) AS q FROM lineitem GROUP BY 1")
def a16_keys(spark, d):
    rows = exact_quantile(table(spark, d, "lineitem"), ["l_returnflag"], C("l_extendedprice"), 0.37, "q")
    return rows.select("l_returnflag", F.round("q", 6).alias("q"))


@register("M15_T8_unusual_claims", index_sql(
    "SELECT claim_id, cluster_id, cluster_size, reserve_amount, outlier_reason FROM ou WHERE outlier_reason IS NOT NULL "
    "ORDER BY reserve_amount DESC, claim_id LIMIT 50", *OUTLIER_SQL))
def m15(spark, d):
    claims = clustered(spark, d, ("reserve_amount",))
    rows = pr.unusual_claims(claims, pr.cluster_measures(claims))
    return rows.select("claim_id", "cluster_id", "cluster_size", "reserve_amount", "outlier_reason")


@register("J5_cluster_sizes", index_sql(
    "SELECT claim_id, coalesce(n, 0) AS cluster_size FROM idx LEFT JOIN (SELECT cluster_id, count(*) AS n FROM idx "
    "WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) > 45) s ON s.cluster_id = idx.cluster_id"))
def j5(spark, d):
    claims = index_claims(spark, d, ())
    sizes = fl.overview_filter(
        pr.cluster_measures(claims).withColumns({c: F.lit("") for c in ("cluster_label", "manual_label", "top_keywords")}),
        ClusterFilters(min_cluster_size=46),
    )
    return pr.with_cluster_size(claims, sizes).select("claim_id", "cluster_size")


@register("M17_J3_J4_map_view", index_sql(
    "SELECT idx.claim_id, idx.cluster_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, CASE WHEN n > 45 THEN 'Cluster ' || idx.cluster_id ELSE 'Unknown' END AS cluster_label, "
    "CASE WHEN idx.cluster_id = 3 THEN 'Selected cluster' ELSE 'Other clusters' END AS selected_cluster, "
    "CASE WHEN reserve_amount IS NULL THEN 'Unknown' WHEN reserve_amount <= 50000 THEN '<=50k' WHEN reserve_amount <= 100000 THEN '50k-100k' "
    "WHEN reserve_amount <= 250000 THEN '100k-250k' ELSE '>250k' END AS reserve_bucket, left(claim_description, 140) AS short_description "
    "FROM idx JOIN (SELECT cluster_id, count(*) AS n FROM idx GROUP BY 1) s ON s.cluster_id = idx.cluster_id "
    "WHERE embedding IS NOT NULL AND claim_status <> 'P'"))
def m17(spark, d):
    claims = index_claims(spark, d, ("claim_status", "reserve_amount"))
    points = claims.where("embedding is not null").select(
        "claim_id", C("embedding")[0].alias("x"), C("embedding")[1].alias("y"), C("claim_description").alias("description")
    )
    shown = claims.where("claim_status <> 'P'").drop("embedding")
    rows = pr.map_view(points, shown, _plain_overview(claims).where("cluster_size > 45"), 3)
    return rows.select(
        "claim_id", "cluster_id", F.round(C("x").cast("double"), 6).alias("x"), "cluster_label", "selected_cluster",
        "reserve_bucket", "short_description",
    )


def _top_sql(measure, shown):
    return index_sql(f"SELECT cluster_id, {shown} AS {measure} FROM me ORDER BY {measure} DESC, cluster_id LIMIT 20", CLUSTERED_SQL, *measures_sql())


def _top(spark, d, measure):
    return pr.top_clusters(pr.cluster_measures(clustered(spark, d, AMOUNTS)), measure)


@register("T5_top_total_reserve", _top_sql("total_reserve", "round(total_reserve, 4)"))
def t5_reserve(spark, d):
    return _top(spark, d, "total_reserve").withColumn("total_reserve", F.round("total_reserve", 4))


@register("T5_top_average_reserve", _top_sql("avg_reserve", "round(avg_reserve, 6)"))
def t5_average(spark, d):
    return _top(spark, d, "avg_reserve").withColumn("avg_reserve", F.round("avg_reserve", 6))


@register("T5_top_total_paid", _top_sql("total_paid", "round(total_paid, 4)"))
def t5_paid(spark, d):
    return _top(spark, d, "total_paid").withColumn("total_paid", F.round("total_paid", 4))


@register("T5_top_size", _top_sql("cluster_size", "cluster_size"))
def t5_size(spark, d):
    return _top(spark, d, "cluster_size")


@register("S18_cluster_reports", index_sql(
    "SELECT ov.cluster_id, concat_ws(chr(10), '# Cluster ' || ov.cluster_id || ' - ' || display_label, '', 'Size: ' || cluster_size || ' claims', "
    "'Review status: ' || review_status, '', '## Keywords', array_to_string(terms, ', '), '', '## Representative Claims', reps, '', "
    "'## Financials', printf('Total reserve: %.2f', total_reserve), printf('Total paid: %.2f', total_paid), "
    "printf('Average reserve: %.2f', avg_reserve), printf('Largest reserve: %.2f', largest)) AS report FROM ov "
    "JOIN lb ON lb.cluster_id = ov.cluster_id JOIN (SELECT rp.cluster_id, string_agg('- ' || rp.claim_id || ': ' || claim_description, chr(10) ORDER BY rank) AS reps "
    "FROM rp JOIN idx ON idx.claim_id = rp.claim_id GROUP BY 1) r ON r.cluster_id = ov.cluster_id "
    "JOIN (SELECT cluster_id, max(reserve_amount) AS largest FROM cc GROUP BY 1) x ON x.cluster_id = ov.cluster_id",
    *OVERVIEW_SQL, *REP_SQL))
def s18(spark, d):
    claims = clustered(spark, d)
    summary = cl.cluster_summary(claims)
    rows = pr.cluster_overview(claims, summary, current_reviews(review_log(spark, d)), MODEL, CLUSTER_VERSION)
    return cluster_reports(rows, summary, pr.cluster_financials(claims, ["cluster_id"]))


@register("M11_kmeans_invariants", index_sql(
    "SELECT claim_id, true AS in_range, true AS unit_centre, CAST(1 AS BIGINT) AS labels FROM idx WHERE embedding IS NOT NULL"))
def m11_invariants(spark, d):
    """Every claim with a vector has one label below k, and every centre has unit length."""
    labelled, centres = cl.cluster_claims(index_claims(spark, d, ()), 12)
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
    ends = centres.select("cluster_id", (F.abs(length - 1) < 1e-9).alias("unit_centre"))
    rows = labelled.where("embedding is not null").join(F.broadcast(ends), "cluster_id", "left")
    return rows.groupBy("claim_id").agg(
        F.every(C("cluster_id").between(0, 11)).alias("in_range"),
        F.every("unit_centre").alias("unit_centre"),
        F.count("*").alias("labels"),
    )


@register("M3_cell_search", index_sql(
    "SELECT query_id, claim_id, round(distance, 6) AS distance, round(greatest(0.0, 1 - distance), 6) AS similarity FROM ("
    "SELECT pr.query_id, idx.claim_id, round(list_cosine_distance(CAST(idx.embedding AS DOUBLE[]), pr.e), 12) + 0.0 AS distance "
    "FROM pr JOIN idx ON idx.cluster_id = pr.cell) "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, claim_id) <= 10",
    *CENTROID_SQL,
    "pr AS (SELECT claim_id AS query_id, e, ce.cluster_id AS cell FROM (SELECT claim_id, CAST(embedding AS DOUBLE[]) AS e FROM idx "
    "WHERE embedding IS NOT NULL), ce QUALIFY row_number() OVER (PARTITION BY claim_id "
    "ORDER BY round(list_cosine_distance(e, centroid), 12), CAST(ce.cluster_id AS VARCHAR)) <= 4)"))
def m3(spark, d):
    """Nearest claims looked for in the four nearest of the given clusters only."""
    claims = index_claims(spark, d, ())
    queries = claims.where("embedding is not null").select(C("claim_id").alias("query_id"), "embedding")
    probes = sem.nearest_cells(queries, cl.centroids(claims), 4)
    hits = sem.similar_claims(claims, queries, top_n=10, cell="cluster_id", probes=probes)
    return hits.select(
        "query_id", "claim_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity")
    )


def planted_vectors(spark, d):
    """Vectors with visible groups, derived from the given ones: each is drawn halfway to one of 40 of them."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    base = vectors.where("vec_id < 40").select(C("vec_id").alias("base"), C("embedding").alias("centre"))
    drawn = F.zip_with("centre", "embedding", lambda c, v: (c + 0.5 * v).cast("double"))
    grouped = vectors.withColumn("base", F.floor(C("vec_id") / 20) % 40).join(F.broadcast(base), "base")  # 40 rows
    return grouped.select(C("vec_id").cast("string").alias("claim_id"), drawn.alias("embedding"))


def _planted_search(spark, d):
    """Every vector whose id is divisible by 20 asks for its ten nearest of all: compressed cells against all pairs."""
    claims = write_once(planted_vectors(spark, d), "planted")
    queries = claims.where(C("claim_id").cast("long") % 20 == 0).select(C("claim_id").alias("query_id"), "embedding")
    path = shared_dir(spark, "cells")
    quantizer = qz.fit_quantizer(claims, cells=48, parts=16, codes=64, sample=16_384)
    qz.write_cells(claims, quantizer, path)
    hits, scored = qz.cell_candidates(qz.CellIndex(spark, path, quantizer), queries, n=10, n_probes=6, candidates=60)
    return qz.recall(hits, sem.nearest_claims(claims, queries, 10)), scored


@register("M3_compressed_cells")
def m3_compressed(spark, d):
    """Recall of every query beside the share of pairs that were looked at."""
    recall, scored = _planted_search(spark, d)
    return recall.withColumn("scored_fraction", scored.scalar())


@register(
    "M3_recall_reached",
    "SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(10 AS BIGINT) AS expected, true AS recall_reached, true AS few_scored "
    "FROM embeddings WHERE vec_id % 20 = 0",
)
def m3_recall_reached(spark, d):
    """The same as yes or no: 0.9 of all nearest claims found, and less than half of all pairs looked at."""
    recall, scored = _planted_search(spark, d)
    recall = write_once(recall, "recall")
    reached = recall.agg(F.sum("found") >= 0.9 * F.sum("expected")).scalar()
    few = scored.select(C("scored_fraction") < 0.5).scalar()
    return recall.select("query_id", "expected", reached.alias("recall_reached"), few.alias("few_scored"))
