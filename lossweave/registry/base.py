"""Registered queries, the claims they read, and the matching SQL building blocks.

The driver tables hold no insurance claims, so a claims view is derived from them: documents
give id and text, parts, orders and customers the attributes, line items the paid amount and
embeddings the vector and a given cluster. Everything is read in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.operators.ingest import prepare_records
from lossweave.runtime import spread
from lossweave.schema import DEFAULT_COLUMNS, ColumnMap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODEL, MODEL_PATH, VERSION = "lexical", "models/lexical", "v1"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan, "doc_id") if name == "documents" else scan


ALL_FIELDS = tuple(f for f in DEFAULT_COLUMNS if f not in ("claim_id", "description"))
_PART = {"claim_type": "p_type", "damaged_object": "p_name", "policy_type": "p_brand"}
_ORDER = {
    "cause_of_loss": "o_orderpriority",
    "claim_status": "o_orderstatus",
    "loss_date": "o_orderdate",
    "reserve_amount": "o_totalprice",
}


_VECTOR = ("embedding", "cluster_id")


def source_claims(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ALL_FIELDS, vectors: bool = False) -> DataFrame:
    """Source claims with the wanted optional fields, and vector and cluster if asked for; only the tables behind them
    are joined, all of them by document id, so that the texts are shuffled once."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    if vectors:
        given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("cluster_id"))
        docs = docs.join(given, key == F.col("vec_id"), "left")
    columns = {
        "claim_id": key.cast("string"),
        "claim_description": F.col("text"),
        "line_of_business": F.col("source"),
        "country": F.col("lang"),
    }
    if set(fields) & set(_PART):
        part = table(spark, sf_dir, "part").select("p_partkey", *_PART.values())
        docs = docs.join(part, key == F.col("p_partkey"), "left")
    if set(fields) & {*_ORDER, "currency"}:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *_ORDER.values())
        if "currency" in fields:
            customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        docs = docs.join(orders, key == F.col("o_orderkey"), "left")
    if "currency" in fields:
        zone = F.col("c_nationkey") % 3
        columns["currency"] = F.when(zone == 0, "EUR").when(zone == 1, "GBP").otherwise("USD")
    if "paid_amount" in fields:
        lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
        paid = lines.agg(F.round(F.sum("l_extendedprice"), 2).alias("paid"))
        docs = docs.join(paid, key == F.col("l_orderkey"), "left")
        columns["paid_amount"] = F.col("paid")
    columns.update({f: F.col(c) for f, c in {**_PART, **_ORDER}.items() if f in fields})
    wanted = ["claim_id", "claim_description", *[f for f in ALL_FIELDS if f in fields]]
    return docs.select(*[columns[c].alias(c) for c in wanted], *(_VECTOR if vectors else ()))


def column_map(fields: tuple[str, ...] = ALL_FIELDS) -> ColumnMap:
    return ColumnMap.of({f: "" for f in ALL_FIELDS if f not in fields})


def records(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ALL_FIELDS, vectors: bool = False) -> DataFrame:
    return prepare_records(
        source_claims(spark, sf_dir, fields, vectors),
        column_map(fields),
        _VECTOR if vectors else (),
        model_name=MODEL,
        model_path=MODEL_PATH,
        embedding_version=VERSION,
    )


def index_claims(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ALL_FIELDS) -> DataFrame:
    """Index records with vector and given cluster (null for claims without one)."""
    return records(spark, sf_dir, fields, vectors=True)


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long review log derived from orders: many reviews per model, version and cluster."""
    statuses = ["unreviewed", "accepted", "needs_split", "needs_merge", "too_mixed", "not_useful"]
    key = F.col("o_orderkey")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad(key.cast("string"), 12, "0"))
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "model-a").otherwise("model-b").alias("model_key"),
        F.col("o_orderpriority").alias("cluster_version"),
        (key % 10).cast("int").alias("cluster_id"),
        F.when(key % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("  label "), F.col("o_custkey").cast("string"))).alias(
            "manual_label"
        ),
        F.get(F.array(*[F.lit(s) for s in statuses]), (key % 6).cast("int")).alias("review_status"),
        F.concat(F.lit("note "), F.col("o_orderstatus")).alias("notes"),
        stamp.alias("updated_at_utc"),
    )


# --- SQL building blocks -------------------------------------------------------------------

TOKEN_SQL = "[0-9A-Za-zÄÖÜäöüß]+"
KEYWORD_SQL = "[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß-]{2,}"


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\s+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOKEN_SQL}'), lambda t: {fold_sql('t')})"


def keywords_sql(x: str, stop_words: set[str] | frozenset[str]) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(stop_words))
    folded = fold_sql(clean_sql(x))
    return f"list_filter(regexp_extract_all({folded}, '{KEYWORD_SQL}'), lambda t: t NOT IN ({stops}))"


def label_sql(label: str, x: str) -> str:
    return f"'{label}: ' || nullif({clean_sql(x)}, '')"


SOURCE_SQL = """src AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS claim_id, d.text AS claim_description, d.source AS line_of_business,
    p.p_type AS claim_type, o.o_orderpriority AS cause_of_loss, p.p_name AS damaged_object, d.lang AS country,
    o.o_orderstatus AS claim_status, o.o_orderdate AS loss_date, o.o_totalprice AS reserve_amount,
    l.paid AS paid_amount,
    CASE c.c_nationkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS currency, p.p_brand AS policy_type
  FROM documents d
  LEFT JOIN part p ON p.p_partkey = d.doc_id
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS paid FROM lineitem GROUP BY 1) l
    ON l.l_orderkey = d.doc_id
)"""

DOCUMENT_SQL = "concat_ws(chr(10), " + ", ".join(
    label_sql(label, column)
    for label, column in (
        ("Claim description", "claim_description"),
        ("Line of business", "line_of_business"),
        ("Claim type", "claim_type"),
        ("Cause of loss", "cause_of_loss"),
        ("Damaged object", "damaged_object"),
        ("Country", "country"),
    )
) + ")"

INDEX_SQL = f"""{SOURCE_SQL}, idx AS (
  SELECT s.claim_id, {DOCUMENT_SQL} AS document, {clean_sql('claim_description')} AS claim_description,
    line_of_business, claim_type, cause_of_loss, damaged_object, country, claim_status,
    strftime(loss_date, '%Y-%m-%dT%H:%M:%S') AS loss_date, CAST(year(loss_date) AS INTEGER) AS loss_year,
    reserve_amount, paid_amount, currency, policy_type,
    CAST(length({clean_sql('claim_description')}) AS INTEGER) AS description_length,
    e.embedding, e.label AS cluster_id
  FROM src s LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = s.claim_id
  WHERE {clean_sql('claim_description')} <> ''
)"""

REVIEW_SQL = """reviews AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'model-a' ELSE 'model-b' END AS model_key,
    o_orderpriority AS cluster_version, CAST(o_orderkey % 10 AS INTEGER) AS cluster_id,
    CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE '  label ' || o_custkey END AS manual_label,
    list_extract(['unreviewed', 'accepted', 'needs_split', 'needs_merge', 'too_mixed', 'not_useful'],
      CAST(o_orderkey % 6 + 1 AS INTEGER)) AS review_status,
    'note ' || o_orderstatus AS notes,
    strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS updated_at_utc
  FROM orders
)"""


def index_sql(body: str, *more: str) -> str:
    """A query over ``idx`` (index claims) with further common table expressions."""
    return "WITH " + ", ".join([INDEX_SQL, *more]) + "\n" + body


def source_sql(body: str) -> str:
    return f"WITH {SOURCE_SQL}\n{body}"
