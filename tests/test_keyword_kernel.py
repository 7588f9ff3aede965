import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lossweave.functions import keywords
from lossweave.functions.keywords import count_texts, score_batches
from lossweave.operators import keyword as kw
from tests.test_search import QUERIES


def batch_of(rows):
    """(id, {term: tf}, dl) as counts."""
    columns = [[r[0] for r in rows], [r[2] for r in rows], [list(r[1]) for r in rows], [list(r[1].values()) for r in rows]]
    kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.nulls(len(rows), pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["claim_id", "dl", "terms", "tfs", "dls"])


def test_a_task_sends_n_hits_per_query_and_they_are_the_best(tmp_path):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    claims = []
    for i in range(900):
        picked = draw.choices(words, weights=range(60, 0, -1), k=draw.randint(1, 40))
        claims.append((f"c{i:03d}", {w: picked.count(w) for w in picked}, len(picked)))
    claims[500:520] = [(c[0], *claims[7][1:]) for c in claims[500:520]]  # ties
    asked = []
    for q in range(30):  # each with a mean length of its own, and two of them over a claim of their own
        asked += [(f"q{q}", w, f"c{q:03d}" if q < 2 else None, 15.0 + q, draw.random()) for w in draw.sample(words, 12)]
    (tmp_path / "slot=0").mkdir()
    names = ["query_id", "term", "exclude_claim_id", "avgdl", "weight"]
    pq.write_table(pa.table({n: pa.array(c, pa.string() if k < 3 else pa.float64()) for k, (n, c) in enumerate(zip(names, zip(*asked)))}), tmp_path / "slot=0" / "a.parquet")
    got = pa.Table.from_batches(score_batches([batch_of(claims[:400]), batch_of(claims[400:])], str(tmp_path), 1, 10, 1.5, 0.75, hold=1)).to_pylist()
    hits = [r for r in got if r["matched"] is None]
    assert len(hits) == 30 * 10
    for q in range(30):
        mine = {w: (own, avg, weight) for n, w, own, avg, weight in asked if n == f"q{q}"}
        own, avg, _ = next(iter(mine.values()))
        scores = {}
        for i, terms, dl in claims:
            parts = [mine[w][2] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) for w, tf in terms.items() if w in mine]
            if parts and i != own:
                scores[i] = round(sum(parts), 9)
        want = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        found = sorted((r for r in hits if r["query_id"] == f"q{q}"), key=lambda r: (-r["raw_score"], r["claim_id"]))
        assert [r["claim_id"] for r in found] == want
        assert [r["raw_score"] for r in found] == pytest.approx([scores[i] for i in want], abs=2e-9)
        assert [r["matched"] for r in got if r["matched"] and r["query_id"] == f"q{q}"] == [len(scores)]


def test_repeated_ids_are_one_claim(spark):
    """Texts of one id are added up, whatever their lengths; no pair of a query and a claim is sent on twice."""
    claims = spark.createDataFrame([("1", "water leak"), ("1", "water leak"), ("2", "water"), ("2", "roof roof water"), ("3", "fire")], "claim_id string, document string")
    counts = {r.claim_id: r for r in kw.counted_claims(claims).collect()}
    assert sorted(counts) == ["1", "2", "3"] and counts["1"].docs == 2 and counts["1"].tfs == [2, 2] and counts["2"].dls == [1, 3, 3]
    scores, _ = kw.bm25_matches(claims, spark.createDataFrame([("q", "water roof", None)], QUERIES))
    assert sorted(r.claim_id for r in scores.collect()) == ["1", "2"]


def test_pairs_are_not_shuffled(spark):
    claims = spark.createDataFrame([(str(i), "water leak") for i in range(50)], "claim_id string, document string")
    scores, _ = kw.bm25_matches(claims, spark.createDataFrame([("q", "water", None)], QUERIES))
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()


def test_texts_are_split_into_tokens_inside_the_tasks(spark, monkeypatch):
    texts = ["Straße STRASSE straße 7", "Äpfel-Öl äpfel", "", None, "leak " * 50, "x\ny"]
    claims = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "claim_id string, document string")
    plan = kw.listed_tokens(claims).where("tokens is not null")
    want = {r.claim_id: (r.dl, {t: r.tokens.count(t) for t in r.tokens}) for r in plan.collect()}
    monkeypatch.setattr(kw, "listed_tokens", None)  # the tokens are not made in rows of their own
    for wanted in (None, spark.createDataFrame([("strasse",), ("leak",)], "term string")):
        got = {r.claim_id: (r.dl, dict(zip(r.terms, r.tfs))) for r in kw.counted_claims(claims, wanted).collect()}
        terms = None if wanted is None else {"strasse", "leak"}
        assert got == {i: (dl, {t: n for t, n in tf.items() if terms is None or t in terms}) for i, (dl, tf) in want.items()}


def test_texts_are_split_some_at_a_time(monkeypatch):
    monkeypatch.setattr(keywords, "_COUNTS_AT_ONCE", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(["one two two", "", "drei"])], names=["claim_id", "document"])
    parts = list(count_texts([batch]))
    assert len(parts) > 1 and [r for p in parts for r in p.column("dl").to_pylist()] == [3, 0, 1]
    assert [sorted(zip(r["terms"], r["tfs"])) for p in parts for r in p.to_pylist()] == [[("one", 1), ("two", 2)], [], [("drei", 1)]]


def test_many_queries_are_made_once(spark, monkeypatch):
    """Queries too many to pin are stored before terms, corpus sizes and their number are taken from them."""
    made = spark.sparkContext.accumulator(0)

    def asked(batches):
        for batch in batches:
            made.add(batch.num_rows)
            ids = [str(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"leak w{i}" for i in ids]), pa.array(ids)], names=["query_id", "query_text", "exclude_claim_id"])

    queries = spark.range(40).mapInArrow(asked, "query_id string, query_text string, exclude_claim_id string")
    claims = spark.createDataFrame([(str(i), f"leak w{i} w{i + 1}") for i in range(60)], "claim_id string, document string")
    want = kw.bm25_candidates(claims, spark.createDataFrame([(str(i), f"leak w{i}", str(i)) for i in range(40)], QUERIES), candidate_pool=3).collect()
    monkeypatch.setattr(kw, "pin_small", lambda frame: (frame, False))
    assert sorted(kw.bm25_candidates(claims, queries, candidate_pool=3).collect()) == sorted(want)
    assert made.value == 40
