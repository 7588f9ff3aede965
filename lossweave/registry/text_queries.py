"""Sources, text and value expressions, ingest counters and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossweave.functions import text as tx, values as vl
from lossweave.functions.stopwords import STOP_WORDS
from lossweave.functions.values import order_bits_sql
from lossweave.functions.vectors import unit_vector
from lossweave.operators import ingest
from lossweave.operators.keyword import with_search_tokens
from lossweave.operators.profiles import claims_view, report_columns
from lossweave.registry.base import (
    DOCUMENT_SQL,
    clean_sql,
    column_map,
    fold_sql,
    index_claims,
    index_sql,
    keywords_sql,
    records,
    register,
    source_claims,
    source_sql,
    table,
    tokens_sql,
)
from lossweave.schema import ColumnMap
from lossweave.sources.claims import logical_claims, mapped_scan, sample_rows
from lossweave.sources.store import lookup_many

C = F.col
DOC_FIELDS = ("line_of_business", "claim_type", "cause_of_loss", "damaged_object", "country")


def _documents(spark, d):
    return records(spark, d, DOC_FIELDS)


@register(
    "S1_mapped_scan",
    source_sql("SELECT claim_id, claim_description, line_of_business, country, claim_status, reserve_amount FROM src"),
)
def s1(spark, d):
    wanted = ("line_of_business", "country", "claim_status", "reserve_amount")
    return mapped_scan(source_claims(spark, d), column_map(wanted))


@register(
    "S2_sample_rows",
    "SELECT doc_id, source FROM documents ORDER BY sha256(doc_id || ':42'), doc_id LIMIT 300",
)
def s2(spark, d):
    return sample_rows(table(spark, d, "documents").select("doc_id", "source"), 300, key="doc_id")


@register(
    "S3_column_map",
    "SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, o_orderpriority AS description, o_orderstatus AS claim_status, "
    "o_totalprice AS reserve_amount, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS DOUBLE) AS paid_amount FROM orders",
)
def s3(spark, d):
    columns = ColumnMap.of(
        {
            **{f: "" for f in column_map().mapped()},
            "claim_id": " key ",
            "description": "o_orderpriority",
            "claim_status": "o_orderstatus",
            "reserve_amount": "o_totalprice",
        }
    )
    orders = table(spark, d, "orders").withColumn("key", C("o_orderkey").cast("string"))
    return logical_claims(orders, columns).select(
        "claim_id", "description", "claim_status", "reserve_amount", "country", "paid_amount"
    )


@register(
    "S6_any_source",
    f"""SELECT conv_id || '-' || turn AS claim_id,
      sha256('Claim description: ' || {clean_sql('text')} || chr(10) || 'Claim type: ' || role) AS source_text_hash,
      role AS claim_type, CAST(length({clean_sql('text')}) AS INTEGER) AS description_length
    FROM conversations WHERE {clean_sql('text')} <> ''""",
)
def s6(spark, d):
    turns = table(spark, d, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    columns = ColumnMap.of(
        {**{f: "" for f in column_map().mapped()}, "claim_id": "key", "description": "text", "claim_type": "role"}
    )
    return ingest.prepare_records(turns, columns).select(
        "claim_id", "source_text_hash", "claim_type", "description_length"
    )


@register(
    "S7_index_scan",
    index_sql("SELECT claim_id, sha256(document) AS source_text_hash, loss_year, currency, cluster_id FROM idx"),
)
def s7(spark, d):
    return index_claims(spark, d).drop("embedding").select(
        "claim_id", "source_text_hash", "loss_year", "currency", "cluster_id"
    )


@register(
    "S8_vector_scan",
    index_sql(
        "SELECT claim_id, CAST(len(embedding) AS INTEGER) AS dims, "
        "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total "
        "FROM idx WHERE embedding IS NOT NULL"
    ),
)
def s8(spark, d):
    rows = index_claims(spark, d, ()).where("embedding is not null")
    total = F.aggregate(C("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("claim_id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


@register(
    "S9_lookup_many",
    index_sql(
        "SELECT claim_id, country, sha256(document) AS source_text_hash FROM idx "
        "WHERE claim_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"
    ),
)
def s9(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(C("doc_id").cast("string").alias("claim_id"))
    return lookup_many(_documents(spark, d), ids).select("claim_id", "country", "source_text_hash")


@register("P1_clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def p1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text(C("text")).alias("cleaned"))


@register("P2_labelled_document", source_sql(f"SELECT claim_id, {DOCUMENT_SQL} AS document FROM src"))
def p2(spark, d):
    claims = logical_claims(source_claims(spark, d, DOC_FIELDS), column_map(DOC_FIELDS))
    parts = {name: C(name) for name in tx.DOCUMENT_LABELS}
    return claims.select("claim_id", tx.labelled_document(parts).alias("document"))


@register("P3_text_hash", source_sql(f"SELECT claim_id, sha256({DOCUMENT_SQL}) AS source_text_hash FROM src"))
def p3(spark, d):
    return _documents(spark, d).select("claim_id", tx.text_hash(C("document")).alias("source_text_hash"))


@register(
    "P4_scalar_values",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp, "
    "strftime(o_orderdate, '%Y-%m-%d') AS day, nullif(trim(o_orderstatus), 'P') AS status, "
    "o_totalprice AS price FROM orders",
)
def p4(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    o = o.withColumn("status", F.when(C("o_orderstatus") == "P", " ").otherwise(C("o_orderstatus")))
    o = o.withColumn("price", C("o_totalprice").cast("decimal(18,2)"))
    t = {f.name: f.dataType for f in o.schema.fields}
    return o.select(
        "o_orderkey",
        vl.iso_text(C("o_orderdate"), t["o_orderdate"]).alias("stamp"),
        vl.iso_text(C("day"), t["day"]).alias("day"),
        vl.iso_text(C("status"), t["status"]).alias("status"),
        vl.number(C("price")).alias("price"),
    )


@register(
    "P5_loss_year",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS loss_year, "
    "CAST(year(o_orderdate) AS INTEGER) AS stamp_year FROM orders",
)
def p5(spark, d):
    text = F.when(C("o_orderstatus") == "P", F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = table(spark, d, "orders")
    return orders.select(
        "o_orderkey",
        vl.loss_year(text).alias("loss_year"),
        vl.loss_year(C("o_orderdate"), orders.schema["o_orderdate"].dataType).alias("stamp_year"),
    )


@register(
    "P6_metadata",
    index_sql(
        "SELECT claim_id, line_of_business, claim_type, cause_of_loss, damaged_object, country, claim_status, loss_date, "
        "loss_year, round(reserve_amount, 2) AS reserve_amount, round(paid_amount, 2) AS paid_amount, currency, "
        "policy_type, description_length, 'lexical' AS embedding_model, 'models/lexical' AS embedding_model_path, "
        "'v1' AS embedding_version, sha256(document) AS source_text_hash FROM idx"
    ),
)
def p6(spark, d):
    rows = records(spark, d).drop("document", "claim_description")
    return rows.withColumns({c: F.round(c, 2) for c in ("reserve_amount", "paid_amount")})


@register(
    "P7_P8_description_length",
    f"SELECT doc_id, CAST(length({clean_sql('text')}) AS INTEGER) AS description_length, "
    f"length({clean_sql('text')}) BETWEEN 1 AND 19 AS is_short FROM documents",
)
def p7(spark, d):
    text = tx.clean_text(C("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.length(text).alias("description_length"), tx.is_short(text).alias("is_short")
    )


@register(
    "P9_prepare_records",
    index_sql(
        "SELECT claim_id, document, claim_description, description_length, loss_year, "
        "round(paid_amount, 2) AS paid_amount FROM idx"
    ),
)
def p9(spark, d):
    return records(spark, d).select(
        "claim_id",
        "document",
        "claim_description",
        "description_length",
        "loss_year",
        F.round("paid_amount", 2).alias("paid_amount"),
    )


@register(
    "P10_search_tokens",
    f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens, "
    f"CAST(len({tokens_sql('text')}) AS INTEGER) AS n FROM documents",
)
def p10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", C("text").alias("document"))
    return with_search_tokens(docs).select(
        "doc_id", F.array_join("search_tokens", " ").alias("tokens"), C("search_token_count").alias("n")
    )


@register(
    "P11_keyword_tokens",
    f"SELECT doc_id, coalesce(array_to_string({keywords_sql('text', STOP_WORDS)}, ' '), '') AS tokens FROM documents",
)
def p11(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(tx.keyword_tokens(C("text")), " ").alias("tokens")
    )


@register(
    "P12_document_fields",
    source_sql(
        f"SELECT claim_id, {clean_sql('claim_description')} AS description, line_of_business, claim_type, "
        "cause_of_loss, damaged_object, country FROM src"
    ),
)
def p12(spark, d):
    rows = _documents(spark, d).select("claim_id", tx.document_fields(C("document")).alias("m"))
    return rows.select("claim_id", *[C("m")[label].alias(name) for name, label in tx.DOCUMENT_LABELS.items()])


@register(
    "P13_keyword_text",
    source_sql(
        f"SELECT claim_id, concat_ws(' ', {clean_sql('claim_description')}, coalesce(claim_type, ''), "
        "coalesce(cause_of_loss, ''), coalesce(damaged_object, '')) AS keyword_text FROM src"
    ),
)
def p13(spark, d):
    return _documents(spark, d).select("claim_id", tx.keyword_text(C("document")).alias("keyword_text"))


@register(
    "P14_document_description",
    source_sql(
        f"SELECT claim_id, {clean_sql('claim_description')} AS from_document, {clean_sql('claim_description')} AS "
        "from_text FROM src"
    ),
)
def p14(spark, d):
    return _documents(spark, d).select(
        "claim_id",
        tx.document_description(C("document")).alias("from_document"),
        tx.document_description(C("claim_description")).alias("from_text"),
    )


@register(
    "P15_display_description",
    source_sql(f"SELECT claim_id, {clean_sql('claim_description')} AS shown FROM src"),
)
def p15(spark, d):
    return _documents(spark, d).select("claim_id", tx.display_description(C("document")).alias("shown"))


@register(
    "P16_similarity",
    "SELECT l_orderkey, l_linenumber, round(greatest(0.0, 1 - l_discount * 15), 6) AS similarity FROM lineitem",
)
def p16(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(vl.similarity(C("l_discount") * 15), 6).alias("similarity")
    )


@register(
    "P17_reserve_bucket",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' WHEN o_totalprice <= 50000 THEN '<=50k' "
    "WHEN o_totalprice <= 100000 THEN '50k-100k' WHEN o_totalprice <= 250000 THEN '100k-250k' ELSE '>250k' END "
    "AS bucket FROM orders",
)
def p17(spark, d):
    text = F.when(C("o_orderstatus") == "P", F.lit("n/a")).otherwise(C("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", vl.reserve_bucket(text).alias("bucket"))


@register(
    "P18_display_label",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus "
    "ELSE 'Cluster ' || o_custkey END AS display_label FROM orders",
)
def p18(spark, d):
    key = C("o_orderkey")
    manual = F.when(key % 3 == 0, C("o_orderpriority")).when(key % 2 == 0, F.lit("  "))
    automatic = F.when(key % 3 != 2, C("o_orderstatus"))
    return table(spark, d, "orders").select(
        "o_orderkey", vl.display_label(manual, automatic, C("o_custkey")).alias("display_label")
    )


@register(
    "P19_cluster_version",
    "SELECT o_orderkey, 'model|' || o_orderstatus || '|' || o_custkey || '|' || "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE o_orderpriority END AS version FROM orders",
)
def p19(spark, d):
    created = F.when(C("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(C("o_orderpriority"))
    version = vl.cluster_version(F.lit("model"), C("o_orderstatus"), C("o_custkey"), created)
    return table(spark, d, "orders").select("o_orderkey", version.alias("version"))


@register(
    "P20_claim_caption",
    index_sql(
        "SELECT claim_id, concat_ws(' - ', claim_id, nullif(concat_ws(' | ', line_of_business, "
        "CASE WHEN claim_status <> 'P' THEN claim_type END, country, claim_status), '')) AS caption FROM idx"
    ),
)
def p20(spark, d):
    fields = ("line_of_business", "claim_type", "country", "claim_status")
    rows = records(spark, d, fields).withColumn("claim_type", F.when(C("claim_status") != "P", C("claim_type")))
    caption = vl.claim_caption(C("claim_id"), [C(f) for f in fields])
    return rows.select("claim_id", caption.alias("caption")).orderBy("claim_id")


@register(
    "P21_report_columns",
    index_sql(
        "SELECT claim_id, document, line_of_business, claim_type, cause_of_loss, country, claim_status, loss_year, "
        "reserve_amount, currency FROM idx"
    ),
)
def p21(spark, d):
    return report_columns(records(spark, d).drop("paid_amount"))


@register("P23_snippet", f"SELECT doc_id, left({clean_sql('text')}, 140) AS snippet FROM documents")
def p23(spark, d):
    return table(spark, d, "documents").select("doc_id", vl.snippet(tx.clean_text(C("text"))).alias("snippet"))


@register(
    "P24_score_items",
    """SELECT l_orderkey, l_linenumber, concat_ws('; ',
      CASE WHEN l_discount > 0 THEN printf('Semantic similarity=%.3f', l_discount)
           WHEN l_tax > 0 THEN printf('Semantic similarity=%.3f', l_tax) END,
      CASE WHEN l_tax > 0 THEN printf('BM25 normalized=%.3f', l_tax) END,
      CASE WHEN l_returnflag = 'A' THEN printf('Rerank=%.3f', l_quantity) END,
      CASE WHEN l_linestatus = 'O' THEN printf('Distance=%.3f', 1 - l_discount) END) AS items FROM lineitem""",
)
def p24(spark, d):
    items = vl.score_items(
        C("l_discount"),
        C("l_tax"),
        C("l_tax"),
        F.when(C("l_returnflag") == "A", C("l_quantity")),
        F.when(C("l_linestatus") == "O", 1 - C("l_discount")),
    )
    shown = F.array_join(F.transform(items, lambda i: F.concat_ws("=", i["label"], i["value"])), "; ")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("items"))


@register(
    "P25_number_text",
    "SELECT o_orderkey, printf('%.3f', o_totalprice) AS score, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) "
    "AS amount, o_orderpriority AS amount_word, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders",
)
def p25(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        vl.score_text(C("o_totalprice")).alias("score"),
        vl.amount_text(C("o_totalprice")).alias("amount"),
        vl.amount_text(C("o_orderpriority")).alias("amount_word"),
        vl.year_text(F.year("o_orderdate").cast("double")).alias("year"),
    )


@register(
    "P27_encoder_prefix",
    source_sql(
        f"SELECT claim_id, 'passage: ' || {DOCUMENT_SQL} AS passage, "
        f"'query: ' || {clean_sql('claim_description')} AS query FROM src"
    ),
)
def p27(spark, d):
    return _documents(spark, d).select(
        "claim_id",
        tx.with_prefix(C("document")).alias("passage"),
        tx.with_prefix(C("claim_description"), tx.QUERY_PREFIX).alias("query"),
    )


@register(
    "P28_selected_flag",
    "SELECT vec_id, CASE WHEN label = 3 THEN 'Selected cluster' ELSE 'Other clusters' END AS flag FROM embeddings",
)
def p28(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vl.selected_flag(C("label"), 3).alias("flag"))


@register(
    "P29_unit_vector",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 5)) AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
    SELECT vec_id, round(CASE WHEN norm > 0 THEN list_sum(e) / norm ELSE 0 END, 6) + 0.0 AS total,
      CAST(CASE WHEN norm > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length FROM n""",
)
def p29(spark, d):
    scaled = F.transform(C("embedding").cast("array<double>"), lambda x: x * (C("vec_id") % 5))
    rows = table(spark, d, "embeddings").select("vec_id", unit_vector(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", (F.round(total, 6) + 0.0).alias("total"), F.round(length, 6).alias("length"))


@register(
    "F1_required_fields",
    "SELECT doc_id FROM documents WHERE lang <> 'fr' AND trim(text) <> '' AND lang <> 'de'",
)
def f1(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.when(C("lang") != "fr", C("doc_id").cast("string")).alias("claim_id"),
        F.when(C("lang") == "de", F.lit(" \n ")).otherwise(C("text")).alias("description"),
    )
    return ingest.has_required(docs).select("doc_id")


_COUNTED = f"""WITH s AS (SELECT CASE WHEN lang = 'fr' AND doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE {clean_sql('text')} END AS t FROM documents)"""


@register(
    "A1_quality_counters",
    f"""{_COUNTED}, k AS (SELECT t FROM s WHERE id <> '' AND t <> '')
    SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM k) AS indexed_rows,
      (SELECT count(*) FROM s WHERE id <> '' AND t = '') AS missing_descriptions,
      (SELECT count(*) FROM k WHERE length(t) < 20) AS short_descriptions,
      (SELECT count(*) - count(DISTINCT {fold_sql('t')}) FROM k) AS duplicate_descriptions,
      (SELECT count(*) FROM s WHERE id = '') AS missing_claim_ids""",
)
def a1(spark, d):
    key = C("doc_id")
    docs = table(spark, d, "documents").select(
        F.when(~((C("lang") == "fr") & (key % 3 == 0)), key.cast("string")).alias("claim_id"),
        F.when(key % 7 == 0, F.lit(" ")).otherwise(C("text")).alias("claim_description"),
    )
    return ingest.quality_counters(docs, column_map(()))


@register(
    "A2_W6_duplicate_ordinals",
    f"""SELECT CAST(doc_id AS VARCHAR) AS claim_id, ordinal, ordinal > 1 AS is_duplicate FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY {fold_sql(clean_sql('text'))} ORDER BY CAST(doc_id AS VARCHAR)) AS ordinal
      FROM documents)""",
)
def a2(spark, d):
    return ingest.duplicate_ordinals(records(spark, d, ()))


def _hash_sql() -> str:
    text = [
        "claim_id", "document", "line_of_business", "claim_type", "cause_of_loss", "damaged_object", "country",
        "claim_status", "loss_date", "loss_year", order_bits_sql("reserve_amount"), order_bits_sql("paid_amount"),
        "currency", "policy_type", "description_length", "'lexical'",
        "'models/lexical'", "'v1'", "sha256(document)",
    ]
    row = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in text) + ")"
    sums = [f"CAST(sum(CAST('0x' || substr(h, {1 + 6 * i}, 6) AS BIGINT)) AS VARCHAR)" for i in range(11)]
    return index_sql(
        f"SELECT sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {', '.join(sums)})) AS dataset_hash, "
        f"count(*) AS record_count FROM (SELECT sha256({row}) AS h FROM idx)"
    )


@register("A11_dataset_hash", _hash_sql())
def a11(spark, d):
    return ingest.dataset_hash(records(spark, d))


_BUCKETS = 16


@register(
    "A11_changed_buckets",
    index_sql("SELECT claim_id, country FROM idx WHERE country = 'fr'"),
)
def a11_changed(spark, d):
    """Claims that a build must look at again after the eighth decimal of the French reserves has changed: those of
    changed buckets, less those whose own digest is the same."""
    before = records(spark, d, ("country", "reserve_amount")).withColumn("reserve_amount", F.lit(0.25))
    after = before.withColumn("reserve_amount", F.when(C("country") == "fr", 0.25 + 1e-8).otherwise(C("reserve_amount")))
    hashes = [ingest.bucket_hashes(rows, _BUCKETS) for rows in (before, after)]
    changed = ingest.changed_buckets(*hashes).withColumnRenamed("bucket", "changed")
    bucket = F.pmod(F.xxhash64("claim_id"), F.lit(_BUCKETS)).cast("int")
    old = before.select("claim_id", vl.order_bits(C("reserve_amount")).alias("old"))
    touched = after.join(F.broadcast(changed), bucket == C("changed")).join(old, "claim_id")  # a row per bucket
    return touched.where(C("old") != vl.order_bits(C("reserve_amount"))).select("claim_id", "country")


def _index_hash_sql() -> str:
    columns = ",".join(f'"{c}"' for c in column_map().selected())
    head = f'{{"source":"parquet","source_identity":"documents","selected_columns":[{columns}],"dataset_hash":"'
    tail = '","model_key":"lexical","model_fingerprint":"1","embedding_version":"v1"}'
    inner = _hash_sql()
    return f"SELECT dataset_hash, record_count, sha256('{head}' || dataset_hash || '{tail}') AS index_hash FROM ({inner})"


@register("A12_index_hash", _index_hash_sql())
def a12(spark, d):
    return ingest.index_hash(
        ingest.dataset_hash(records(spark, d)),
        source="parquet",
        source_identity="documents",
        selected_columns=column_map().selected(),
        model_key="lexical",
        model_fingerprint="1",
        embedding_version="v1",
    )


_VIEW = "SELECT claim_id, {} FROM idx WHERE cluster_id = 3 ORDER BY {} LIMIT 200"


@register("T6_largest_claims", index_sql(_VIEW.format("reserve_amount", "reserve_amount DESC, claim_id")))
def t6_largest(spark, d):
    return _view(spark, d, "largest", "reserve_amount")


@register("T6_newest_claims", index_sql(_VIEW.format("loss_date", "loss_date DESC, claim_id")))
def t6_newest(spark, d):
    return _view(spark, d, "newest", "loss_date")


@register("T6_weakest_claims", index_sql(_VIEW.format("description_length", "description_length, claim_id")))
def t6_weakest(spark, d):
    return _view(spark, d, "weakest", "description_length")


def _view(spark, d, view, column):
    claims = index_claims(spark, d, ("loss_date", "reserve_amount")).where("cluster_id = 3")
    return claims_view(claims, view).limit(200).select("claim_id", column)


@register(
    "T7_claims_snapshot",
    index_sql("SELECT claim_id, document, loss_year, reserve_amount FROM idx ORDER BY claim_id LIMIT 100"),
)
def t7(spark, d):
    rows = report_columns(claims_view(records(spark, d))).limit(100)
    return rows.select("claim_id", "document", "loss_year", "reserve_amount")


@register(
    "U3_distinct_terms",
    f"SELECT lang, count(DISTINCT t) AS terms FROM (SELECT lang, unnest({tokens_sql('text')}) AS t FROM documents) GROUP BY 1",
)
def u3(spark, d):
    docs = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(tx.search_tokens(C("text")))).alias("t"))
    return docs.groupBy("lang").agg(F.count_distinct("t").alias("terms"))
