"""Store versions, upserts, patches, manifests, artefacts, reviews and exports."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F, types as T

from lossweave.operators import clusters as cl, encode, ingest, profiles as pr
from lossweave.plans.index_build import IndexSettings, build_index
from lossweave.registry.base import (
    REVIEW_SQL,
    column_map,
    index_claims,
    index_sql,
    label_sql,
    records,
    register,
    review_log,
    source_claims,
    table,
)
from lossweave.registry.cluster_queries import CLUSTERED_SQL, CURRENT_SQL, clustered, measures_sql
from lossweave.registry.text_queries import _hash_sql
from lossweave.runtime import shared_dir, write_once
from lossweave.schema import MANIFEST_SCHEMA
from lossweave.sources import reviews as rv, store as st
from lossweave.sources.exports import cluster_claims_export, write_csv

C = F.col


def new_store(spark, label):
    return st.ClaimStore(spark, shared_dir(spark, label))


@register("S10_table_version", index_sql("SELECT claim_id, sha256(document) AS source_text_hash, loss_year FROM idx"))
def s10(spark, d):
    store = new_store(spark, "table")
    store.write_table("claims_v1", records(spark, d))
    return store.scan("claims_v1").select("claim_id", "source_text_hash", "loss_year")


_UPSERTED = ("claim_id", "country", "claim_status", "description_length")


def _new_rows(base):
    """Rows to upsert: all German claims reopened, each twice, and as many under new ids."""
    german = base.where("country = 'de'").withColumn("claim_status", F.lit("R"))
    return german.unionByName(german).unionByName(german.withColumn("claim_id", F.concat(F.lit("n"), "claim_id")))


@register(
    "S11_J12_U2_upsert",
    index_sql(
        "SELECT claim_id, country, CASE WHEN country = 'de' THEN 'R' ELSE claim_status END AS claim_status, description_length FROM idx "
        "UNION ALL SELECT 'n' || claim_id, country, 'R', description_length FROM idx WHERE country = 'de'"
    ),
)
def s11(spark, d):
    base = records(spark, d, ("country", "claim_status"))
    return st.upsert(base, _new_rows(base)).select(*_UPSERTED)


@register(
    "S12_J8_patch",
    index_sql(
        "SELECT claim_id, e.label AS cluster_id, CASE WHEN e.vec_id % 2 = 0 THEN 'patched' ELSE claim_status END AS claim_status "
        "FROM idx LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = claim_id"
    ),
)
def s12(spark, d):
    updates = table(spark, d, "embeddings").select(
        C("vec_id").cast("string").alias("claim_id"),
        C("label").alias("cluster_id"),
        F.when(C("vec_id") % 2 == 0, "patched").alias("claim_status"),
    )
    return st.patch(records(spark, d, ("claim_status",)), updates).select("claim_id", "cluster_id", "claim_status")


def _manifest(spark, d):
    """A manifest row derived from the records, without building the index."""
    hashed = ingest.dataset_hash(records(spark, d))
    values = {
        "refreshed_at_utc": F.lit("2024-01-01T00:00:00+00:00"),
        "collection_name": F.concat(F.lit("claims_"), F.substring("dataset_hash", 1, 12)),
        "model_key": F.lit("lexical"),
        "dataset_hash": C("dataset_hash"),
        "index_hash": C("dataset_hash"),
        "record_count": C("record_count"),
    }
    return hashed.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST_SCHEMA.fields]
    )


@register("S13_manifest_log", _hash_sql())
def s13(spark, d):
    store = new_store(spark, "manifest")
    assert store.manifest("lexical").count() == 0
    old = _manifest(spark, d).withColumns(
        {"refreshed_at_utc": F.lit("2023-01-01T00:00:00+00:00"), "record_count": F.lit(0).cast("long")}
    )
    store.activate("lexical", old)
    store.activate("lexical", _manifest(spark, d))
    return store.manifest("lexical").select("dataset_hash", "record_count")


@register(
    "S14_cluster_artefact",
    index_sql(
        "SELECT cluster_id, count(*) AS size, 'KMeans' AS algorithm, CAST(12 AS INTEGER) AS n_clusters FROM cc GROUP BY 1", CLUSTERED_SQL
    ),
)
def s14(spark, d):
    store = new_store(spark, "clusters")
    summary = cl.cluster_summary(clustered(spark, d))
    run = {"n_clusters": F.lit(12), "algorithm": F.lit("KMeans"), "random_state": F.lit(42)}
    for stamp in ("2024-01-01", "2024-02-01"):
        store.write_clusters("lexical", summary.withColumns({**run, "clustered_at_utc": F.lit(stamp)}))
    return store.clusters("lexical").select("cluster_id", "size", "algorithm", "n_clusters")


@register(
    "S15_review_log",
    f"WITH {REVIEW_SQL} SELECT model_key, cluster_version, cluster_id, review_status, notes, updated_at_utc FROM reviews",
)
def s15(spark, d):
    path = shared_dir(spark, "reviews")
    assert rv.load_review_log(spark, path).count() == 0
    review_log(spark, d).write.mode("append").json(path)
    names = ("model_key", "cluster_version", "cluster_id", "review_status", "notes", "updated_at_utc")
    return rv.load_review_log(spark, path).select(*names)


_REVIEW_COLUMNS = "model_key, cluster_version, cluster_id, trim(manual_label) AS manual_label, review_status, notes, updated_at_utc"


@register("S16_W5_current_reviews", f"WITH {', '.join(CURRENT_SQL)} SELECT {_REVIEW_COLUMNS} FROM cr")
def s16(spark, d):
    return rv.current_reviews(review_log(spark, d)).withColumn("manual_label", F.trim("manual_label"))


@register("T9_review_history", f"WITH {REVIEW_SQL} SELECT {_REVIEW_COLUMNS} FROM reviews ORDER BY updated_at_utc DESC")
def t9(spark, d):
    return rv.review_history(review_log(spark, d)).withColumn("manual_label", F.trim("manual_label"))


@register(
    "S17_csv_overview",
    index_sql(
        "SELECT cluster_id, cluster_size, round(total_reserve, 4) AS total_reserve, dominant_country FROM me", CLUSTERED_SQL, *measures_sql()
    ),
)
def s17(spark, d):
    path = shared_dir(spark, "overview-csv")
    rows = pr.cluster_measures(clustered(spark, d))
    write_csv(rows.select("cluster_id", "cluster_size", F.round("total_reserve", 4).alias("total_reserve"), "dominant_country"), path)
    schema = "cluster_id int, cluster_size bigint, total_reserve double, dominant_country string"
    return spark.read.schema(schema).option("header", True).csv(path)


@register(
    "S17_csv_claims",
    index_sql("SELECT claim_id, document, country, loss_year FROM idx WHERE cluster_id = 3 AND contains(lower(document), 'en')"),
)
def s17_claims(spark, d):
    path = shared_dir(spark, "claims-csv")
    rows = cluster_claims_export(clustered(spark, d), 3, "EN", "newest")
    write_csv(rows, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    back = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("claim_id", "document", "country", "loss_year")


@register(
    "S19_artefact_freshness",
    index_sql("SELECT cluster_id, count(*) AS size FROM cc WHERE cluster_id % 2 = 0 GROUP BY 1", CLUSTERED_SQL),
)
def s19(spark, d):
    manifest = _manifest(spark, d)
    active = manifest.select("index_hash").scalar()
    sizes = clustered(spark, d, ()).groupBy("cluster_id").agg(F.count("*").alias("size"))
    artefacts = sizes.withColumn("index_hash", F.when(C("cluster_id") % 2 == 0, active).otherwise("stale"))
    return st.matching_artefacts(artefacts, manifest).select("cluster_id", "size")


@register(
    "M18_index_build",
    "SELECT step, status, (SELECT count(*) FROM documents WHERE trim(text) <> '' AND keep) AS record_count "
    "FROM (VALUES (CAST(1 AS INTEGER), 'rebuilt', true), (2, 'current', true), (4, 'activated_existing', true)) v(step, status, keep) "
    "UNION ALL SELECT 3, 'rebuilt', (SELECT count(*) FROM documents WHERE trim(text) <> '' AND lang <> 'fr')",
)
def m18(spark, d):
    """All claims, the same again, the claims without one country, and all again."""
    store = new_store(spark, "index")
    fields = ("line_of_business", "country")
    source = source_claims(spark, d, fields)
    fewer = source.where("country <> 'fr'")

    def embed(rows):
        return encode.lexical_encode(rows, encode.fit_lexical_encoder(rows))

    settings = IndexSettings(model_key="lexical", model_version="1")
    done = []
    for step, rows in enumerate((source, source, fewer, source), start=1):
        result = build_index(
            store, rows, embed, settings, source_name="parquet", source_identity="documents", columns=column_map(fields)
        )
        done.append((step, result.status, result.manifest["record_count"]))
    return spark.createDataFrame(done, "step int, status string, record_count bigint")


def _by_digest():
    """An encoder whose vector depends on the text alone: eight numbers of its digest."""
    return lambda texts: [[b + 1.0 for b in hashlib.md5(t.encode()).digest()[:8]] for t in texts]


@register(
    "M18_reused_vectors",
    index_sql(
        "SELECT claim_id, sha256(document) AS source_text_hash, true AS same_vector, 'rebuilt' AS status, CAST(encoded AS BIGINT) AS encoded, "
        "'rebuilt' AS last_status, CAST(0 AS BIGINT) AS last_encoded FROM plain, "
        "(SELECT count(DISTINCT document) FILTER (NOT EXISTS (SELECT 1 FROM plain p WHERE p.country <> 'fr' AND p.document = o.document)) AS encoded FROM plain o)",
        f"plain AS (SELECT claim_id, country, concat_ws(chr(10), {label_sql('Claim description', 'claim_description')}, "
        f"{label_sql('Country', 'country')}) AS document FROM idx)",
    ),
)
def m18_reused(spark, d):
    """The claims without one country, then all: only the new texts are encoded. Then the same claims, half of them
    twice, with a change in the eighth decimal of the reserves: another version, and nothing is encoded."""
    store = new_store(spark, "index")
    fields = ("country", "reserve_amount")
    source = write_once(source_claims(spark, d, fields), "source", "zstd")  # joined once, read by every build
    settings = IndexSettings(model_key="digest", model_version="1")

    def embed(rows):
        return encode.encode(rows, "document", _by_digest)

    def build(rows):
        return build_index(
            store, rows, embed, settings, source_name="parquet", source_identity="documents", columns=column_map(fields), reuse_vectors=True
        )

    build(source.where("country <> 'fr'"))
    second = build(source)
    moved = source.withColumn("reserve_amount", C("reserve_amount") + 1e-8)
    third = build(moved.unionByName(moved.where("country <> 'de'")))
    stored = store.read_table(third.collection_name).select("claim_id", "source_text_hash", "embedding")
    direct = embed(ingest.prepare_records(source, column_map(fields))).select("claim_id", C("embedding").alias("direct"))
    steps = {"status": second.status, "encoded": second.embedded, "last_status": third.status, "last_encoded": third.embedded}
    rows = stored.join(direct, "claim_id").withColumn("same_vector", C("embedding") == C("direct"))
    literals = [F.lit(v).cast("bigint" if isinstance(v, int) else "string").alias(k) for k, v in steps.items()]
    return rows.select("claim_id", "source_text_hash", "same_vector", *literals)
