"""What is costly is done once: texts are shuffled once, vectors made once, documents cleaned once."""

import pyarrow as pa
from pyspark.sql import functions as F

from lossweave.functions.text import document_entries
from lossweave.operators import semantic as sem
from lossweave.plans import search as plan
from lossweave.registry import search_queries
from lossweave.registry.base import index_claims
from lossweave.schema import SearchSpec


def test_entries_clean_a_document_once(spark):
    plan = spark.range(1).select(document_entries(F.col("id").cast("string")).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2  # the cleaning and the marks


def test_entries_begin_at_labels_only(spark):
    text = "x country: DE Claim Type: claim type: a  line of business:b Xcountry: c lossof: Country:"
    entries = spark.createDataFrame([(text,)], "d string").select(document_entries(F.col("d")).alias("e")).first().e
    assert [(e.label, e.value) for e in entries] == [
        ("country", "DE"), ("claim type", "claim type: a"), ("line of business", "b Xcountry: c lossof:"), ("country", "")
    ]


def test_vectors_are_made_once_for_a_search(spark):
    made = spark.sparkContext.accumulator(0)

    def vectors(batches):
        for batch in batches:
            made.add(batch.num_rows)
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([[1.0 + i, 2.0, 0.5 * i] for i in ids])], names=["claim_id", "embedding"])

    claims = spark.range(500).mapInArrow(vectors, "claim_id string, embedding array<double>")
    queries = spark.createDataFrame([("a", [1.0, 2.0, 0.0])], "query_id string, embedding array<double>")
    hits = sem.nearest_claims(claims, queries, 3, sample=50).orderBy("distance").collect()
    assert [h.claim_id for h in hits] == ["0", "1", "2"] and made.value == 500


def test_claims_view_shuffles_texts_once(spark, tmp_path):
    rows = {
        "documents": ([(1, "a text", "src", "de"), (2, "b text", "src", "en"), (2, "b text", "src", "en"), (None, "lost", "src", "de"), (3, " ", "src", "de")], "doc_id long, text string, source string, lang string"),
        "embeddings": ([(1, [1.0, 0.0], 4), (2, [0.0, 1.0], 5), (2, [0.5, 1.0], 6), (None, [1.0, 1.0], 7)], "vec_id long, embedding array<float>, label int"),
        "part": ([(1, "t", "n", "b")], "p_partkey long, p_type string, p_name string, p_brand string"),
        "orders": ([(2, 9, "1-URGENT", "O", None, 10.0), (1, None, "2-HIGH", "F", None, 5.0)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date, o_totalprice double"),
        "customer": ([(9, 1), (None, 0)], "c_custkey long, c_nationkey int"),
        "lineitem": ([(1, 2.5), (1, 1.0)], "l_orderkey long, l_extendedprice double"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = index_claims(spark, str(tmp_path))
        got = sorted((r.claim_id, r.cluster_id, r.currency, r.paid_amount, r.claim_type) for r in claims.collect())
        shuffles = claims._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == [("1", 4, "USD", 3.5, "t"), ("2", 5, "GBP", None, None), ("2", 5, "GBP", None, None), ("2", 6, "GBP", None, None), ("2", 6, "GBP", None, None)]
    assert shuffles.count("Exchange hashpartitioning(doc_id") + shuffles.count("Exchange hashpartitioning(claim_id") == 1


def counted_queries(spark):
    """Queries by example, and how many rows of them were made so far."""
    made = spark.sparkContext.accumulator(0)

    def queries(batches):
        for batch in batches:
            made.add(batch.num_rows)
            ids = batch.column(0).to_pylist()
            columns = [[str(i) for i in ids], [f"leak w{i}" for i in ids], [str(i) for i in ids], [[1.0 + i, 2.0] for i in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_text", "exclude_claim_id", "embedding"])

    schema = "query_id string, query_text string, exclude_claim_id string, embedding array<double>"
    claims = spark.createDataFrame([(str(i), f"leak w{i} w{i % 7}", [2.0, 1.0 + i]) for i in range(30)], "claim_id string, document string, embedding array<double>")
    return claims, spark.range(12).mapInArrow(queries, schema), made


def test_queries_of_a_search_are_made_once(spark, monkeypatch):
    claims, queries, made = counted_queries(spark)
    monkeypatch.setattr(plan, "pin_small", lambda frame: (frame, False))  # as with many queries
    assert plan.search(claims, queries, SearchSpec(mode="Hybrid", top_n=2)).count() == 24
    assert made.value == 12


def test_queries_of_a_fusion_are_made_once(spark, monkeypatch):
    claims, queries, made = counted_queries(spark)
    monkeypatch.setattr(search_queries, "index_claims", lambda *_: claims)
    monkeypatch.setattr(search_queries, "example_queries", lambda *_: queries)
    assert search_queries._fused(spark, "").groupBy("query_id").count().count() == 12
    assert made.value == 12
