import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lossweave.functions.vectors import Nearest, as_matrix, closest_batches, nearest_batches
from lossweave.operators import encode, filters as fl, fusion, keyword as kw, semantic as sem
from lossweave.operators.clusters import centroids
from lossweave.plans.search import search
from lossweave.schema import SearchFilters, SearchSpec

QUERIES = "query_id string, query_text string, exclude_claim_id string"


def tokens(text):
    return [t.casefold() for t in re.findall("[0-9A-Za-zÄÖÜäöüß]+", text)]


def brute_bm25(query, documents):
    """Raw scores by id, written from the formula."""
    docs = {i: tokens(d) for i, d in documents.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, words in docs.items():
        score = 0.0
        for term in tokens(query):
            tf, df = words.count(term), sum(term in w for w in docs.values())
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        out[i] = score
    return out


def brute_candidates(query, documents, pool=100):
    raw = {i: round(s, 9) for i, s in brute_bm25(query, documents).items()}
    low, high = min(raw.values()), max(raw.values())
    scaled = {i: (s - low) / (high - low) if high > low else float(high > 0) for i, s in raw.items()}
    best = sorted((i for i in scaled if scaled[i] > 0), key=lambda i: (-raw[i], i))[:pool]
    return {i: scaled[i] for i in best}


def test_search_filters(spark):
    rows = spark.createDataFrame(
        [("1", 2023, 10.0, 1.0), ("2", 2024, 50.0, 5.0), ("3", 2025, 100.0, 10.0), ("4", 2024, float("nan"), None)],
        "claim_id string, loss_year int, reserve_amount double, paid_amount double",
    )
    filters = SearchFilters(loss_year=(2024, 2025), reserve_amount=(20.0, 90.0), paid_amount=(None, 8.0))
    assert [r[0] for r in fl.search_filter(rows, filters).select("claim_id").collect()] == ["2"]
    low = SearchFilters(reserve_amount=(20.0, None), equality={"country": "DE"})
    assert fl.search_filter(rows, low).count() == 2  # NaN is no number; the absent field is ignored


def test_filters_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "claims")
    spark.createDataFrame([("1", "DE", 2024, 5.0, "x")], "claim_id string, country string, loss_year int, reserve_amount double, document string").write.parquet(path)
    filters = SearchFilters(equality={"country": "DE"}, loss_year=(2020, None), reserve_amount=(1.0, 9.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = fl.search_filter(spark.read.parquet(path), filters).select("claim_id")._jdf.queryExecution().toString()
    assert "EqualTo(country,DE)" in plan and "GreaterThanOrEqual(loss_year,2020)" in plan
    assert "LessThanOrEqual(reserve_amount,9.0)" in plan
    assert "document" not in plan.split("ReadSchema")[1]


def test_filtered_candidates(spark):
    claims = spark.createDataFrame(
        [("1", "water leakage warehouse", "DE"), ("2", "fire damage", "DE"), ("3", "water leakage apartment", "AT")],
        "claim_id string, document string, country string",
    )
    queries = spark.createDataFrame([("q", "water leakage")], "query_id string, query_text string")
    got = kw.bm25_candidates(claims, queries, SearchFilters(equality={"country": "DE"}), 10).collect()
    assert [(r["claim_id"], r["bm25_score"]) for r in got] == [("1", 1.0)]


@pytest.mark.parametrize("stored", [False, True])
def test_bm25_against_the_formula(spark, stored):
    rng = random.Random(7)
    words = ["water", "Fire", "straße", "pipe", "hail", "roof", "car"]
    documents = {f"c{i:03d}": " ".join(rng.choices(words, k=rng.randint(1, 9))) for i in range(60)}
    documents["c900"] = documents["c000"]  # equal texts must tie
    claims = spark.createDataFrame(list(documents.items()), "claim_id string, document string").repartition(5)
    if stored:
        claims = kw.with_search_tokens(claims)
    asked = [("a", "water pipe water", None), ("b", "hail", "c001"), ("c", "nothing known", None), ("d", documents["c002"], "c002")]
    asked.append(("e", " ".join(words), "missing"))
    got = {}
    for r in kw.bm25_candidates(claims, spark.createDataFrame(asked, QUERIES), candidate_pool=20).collect():
        got.setdefault(r["query_id"], {})[r["claim_id"]] = r["bm25_score"]
    for query_id, text, own in asked:
        want = brute_candidates(text, {i: d for i, d in documents.items() if i != own}, 20)
        assert got.get(query_id, {}) == pytest.approx(want, abs=1e-6)


def test_large_query_batches_take_the_shuffled_way(spark, monkeypatch):
    documents = {"1": "water leak", "2": "fire", "3": "water water"}
    claims = spark.createDataFrame(list(documents.items()), "claim_id string, document string")
    queries = spark.createDataFrame([("a", "water", "3"), ("b", "fire leak", None)], QUERIES)
    small = kw.bm25_candidates(claims, queries).collect()
    monkeypatch.setattr(kw, "pin_small", lambda df: (df, False))
    assert sorted(kw.bm25_candidates(claims, queries).collect()) == sorted(small)


def test_all_match_drops_the_weakest(spark):
    claims = spark.createDataFrame([("1", "water"), ("2", "water leak"), ("3", "water")], "claim_id string, document string")
    queries = spark.createDataFrame([("q", "water")], "query_id string, query_text string")
    assert [r["claim_id"] for r in kw.bm25_candidates(claims, queries).orderBy("claim_id").collect()] == ["1", "3"]


def vectors(n, d=8, seed=1):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def vector_claims(spark, matrix, cells=None):
    rows = [(f"c{i:04d}", [float(x) for x in v], int(cells[i]) if cells is not None else 0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "claim_id string, embedding array<float>, cluster_id int")


def brute_nearest(matrix, query, n, keep=lambda i: True):
    unit = matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)
    distance = np.round(1 - unit @ (query / np.linalg.norm(query)), 12)
    return sorted((float(distance[i]), f"c{i:04d}") for i in range(len(matrix)) if keep(i))[:n]


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_claims_with_hot_copies(spark, block):
    matrix = vectors(300)
    matrix[100:200] = matrix[0]  # a third of all rows are copies
    claims = vector_claims(spark, matrix).repartition(6)
    asked = matrix[[0, 5, 250, 299]].astype(float)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(asked)], "query_id string, embedding array<float>")
    got = {}
    for r in sem.nearest_claims(claims, queries, 7, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["claim_id"]))
    for i, query in enumerate(asked):
        want = brute_nearest(matrix, query, 7)
        assert [c for _, c in sorted(got[f"q{i}"])] == [c for _, c in want]
        assert [d for d, _ in sorted(got[f"q{i}"])] == pytest.approx([d for d, _ in want], abs=1e-9)


def test_nearest_keeps_ties_in_id_order_over_batches():
    best = Nearest(2, 2)
    for rows in ([3, 2], [1], [0, 4, 5], *([[6]] * 40)):
        best.add(np.array(rows), np.array([0, 1]), np.array([[0.0, -r] for r in rows]))
    query, distance, row = best.best()
    assert list(zip(query, row)) == [(0, 0), (0, 1), (1, 6), (1, 6)] and distance.tolist() == [0, 0, -6, -6]
    assert best.limit == 4 * 2 * 2


def test_vectors_stay_off_the_driver(spark, monkeypatch):
    matrix = vectors(60)
    claims = vector_claims(spark, matrix)
    queries = claims.select(F.col("claim_id").alias("query_id"), "embedding")
    plan = sem.nearest_claims(claims, queries, 3, block=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one pass over the claims for all blocks
    with pytest.raises(ValueError):
        sem.nearest_claims(claims, queries.union(queries.limit(1)), 3)


def test_vectors_of_other_lengths_are_an_error():
    assert as_matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1, 2], [3, 4]]
    for wrong in ([[1.0, 2.0], [3.0]], [[1.0], [2.0, 3.0, 4.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            as_matrix(pa.array(wrong))


def test_kernels_run_without_the_package(tmp_path):
    """Executors have no copy of this package: a kernel must load from its pickle alone."""
    path = tmp_path / "kernel"
    path.write_bytes(cloudpickle.dumps((nearest_batches, closest_batches)))
    load = "import pickle, sys; print([f.__name__ for f in pickle.load(open(sys.argv[1], 'rb'))], 'lossweave' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", load, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "['nearest_batches', 'closest_batches'] False", done.stderr


def test_ranges_come_first_unless_asked_otherwise(spark):
    matrix = vectors(120)
    claims = vector_claims(spark, matrix).withColumn("loss_year", F.when(F.col("claim_id") == "c0003", 2024).otherwise(2000))
    queries = spark.createDataFrame([("q", [float(x) for x in -matrix[3]], "c0001")], "query_id string, embedding array<float>, exclude_claim_id string")
    filters = SearchFilters(loss_year=(2020, None))
    later = sem.similar_claims(claims, queries, filters, postfilter_ranges=True)
    assert later.count() == 0  # the only match is the farthest row
    complete = sem.similar_claims(claims, queries, filters).collect()
    assert [r["claim_id"] for r in complete] == ["c0003"] and complete[0]["similarity"] == 0.0


def test_cell_search_on_planted_groups(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:6] * 5
    labels = np.repeat(np.arange(6), 50)
    matrix = (centres[labels] + rng.normal(scale=0.2, size=(300, 8))).astype(np.float32)
    claims = vector_claims(spark, matrix, labels)
    queries = claims.select(F.col("claim_id").alias("query_id"), "embedding")
    probes = sem.nearest_cells(queries, centroids(claims), 1)
    exact = {tuple(r) for r in sem.nearest_claims(claims, queries, 10).select("query_id", "claim_id").collect()}
    found = {tuple(r) for r in sem.nearest_claims(claims, queries, 10, cell="cluster_id", probes=probes).select("query_id", "claim_id").collect()}
    share = sem.scored_fraction(claims, queries, probes, "cluster_id").first()["fraction"]
    assert share == pytest.approx(1 / 6)
    assert len(found & exact) / len(exact) > 0.99


def test_assign_nearest_in_blocks(spark):
    matrix, centres = vectors(80), vectors(9, seed=5)
    claims = vector_claims(spark, matrix)
    targets = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster_id int, centroid array<double>")
    whole = {r["claim_id"]: r["cluster_id"] for r in sem.assign_nearest(claims, targets).collect()}
    assert whole == {r["claim_id"]: r["cluster_id"] for r in sem.assign_nearest(claims, targets, block=2).collect()}
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    assert whole == {f"c{i:04d}": int(np.argmax(unit @ v)) for i, v in enumerate(matrix)}


def test_fusion(spark):
    semantic = spark.createDataFrame([("q", "1", "water", 0.8, 0.2)], "query_id string, claim_id string, document string, semantic_score double, distance double")
    words = spark.createDataFrame([("q", "1", "WATER", 0.4), ("q", "2", "leakage", 1.0)], "query_id string, claim_id string, document string, bm25_score double")
    rows = {r["claim_id"]: r for r in fusion.fuse(semantic, words, "Hybrid", 0.5).collect()}
    assert rows["1"]["final_score"] == pytest.approx(0.6) and rows["1"]["document"] == "water"
    assert rows["2"]["final_score"] == 0.5 and rows["2"]["distance"] is None and rows["2"]["semantic_score"] == 0.0
    assert [r["final_score"] for r in fusion.fuse(semantic, words, "Semantic").collect()] == [0.8]
    assert fusion.fuse(None, words, "BM25").count() == 2


def test_rerank_replaces_scores_and_drops_the_rest(spark):
    hits = spark.createDataFrame(
        [("q", "x", "1", "water", 0.9), ("q", "x", "2", "fire", 0.5), ("q", "x", "3", "hail", 0.1)],
        "query_id string, query_text string, claim_id string, document string, final_score double",
    )

    def scorer():
        return lambda queries, documents: [{"water": 0.1, "fire": 0.9}[d] for d in documents]

    rows = fusion.rerank(hits, 2, scorer).orderBy(F.col("final_score").desc()).collect()
    assert [(r["claim_id"], r["rerank_score"]) for r in rows] == [("2", 1.0), ("1", 0.0)]


def test_user_models_run_once_per_row(spark, tmp_path):
    calls = str(tmp_path)

    def note(count):
        with open(os.path.join(calls, f"{os.getpid()}"), "a") as out:
            out.write("x" * count)

    def counted():
        total = sum(os.path.getsize(os.path.join(calls, f)) for f in os.listdir(calls))
        for f in os.listdir(calls):
            open(os.path.join(calls, f), "w").close()
        return total

    def encoder():
        def run(texts):
            note(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return run

    def scorer():
        def run(queries, documents):
            note(len(documents))
            return [float(len(d)) for d in documents]

        return run

    claims = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(30)], "claim_id string, document string")
    encode.encode(claims, "document", encoder).where("embedding is not null").select("claim_id", "embedding").collect()
    assert counted() == 30
    hits = claims.select(F.lit("q").alias("query_id"), "claim_id", F.lit("t").alias("query_text"), "document", F.lit(1.0).alias("final_score"))
    fusion.rescore(hits, scorer).collect()
    assert counted() == 30


def test_search_end_to_end_with_a_plugged_encoder(spark):
    def encoder():
        return lambda texts: np.array([[t.count("water") + 0.01, t.count("fire") + 0.01] for t in texts])

    claims = spark.createDataFrame(
        [("1", "Claim description: water leak"), ("2", "Claim description: fire"), ("3", "Claim description: water and fire")],
        "claim_id string, document string",
    )
    claims = encode.encode(claims, "document", encoder)
    queries = spark.createDataFrame([(1, "water leak"), (2, " ")], "query_id int, query_text string")
    queries = encode.encode(queries, "query_text", encoder, prefix="query: ")
    for mode in ("Semantic", "BM25", "Hybrid"):
        rows = search(claims, queries, SearchSpec(mode=mode, top_n=2)).orderBy("rank").collect()
        assert rows[0]["claim_id"] == "1" and {r["query_id"] for r in rows} == {"1"}, mode
    reranked = search(claims, queries, SearchSpec(mode="Hybrid", rerank=True)).orderBy("rank").collect()
    assert reranked[0]["claim_id"] == "1" and reranked[0]["rerank_score"] == 1.0
    with pytest.raises(ValueError):
        SearchSpec(mode="Other")


def test_lexical_encoder_gives_unit_vectors(spark):
    claims = spark.createDataFrame([("1", "water leak"), ("2", "fire")], "claim_id string, document string")
    rows = encode.lexical_encode(claims, encode.fit_lexical_encoder(claims, dimensions=16)).collect()
    assert [len(r["embedding"]) for r in rows] == [16, 16]
    assert [sum(x * x for x in r["embedding"]) for r in rows] == pytest.approx([1.0, 1.0], abs=1e-5)
