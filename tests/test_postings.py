import random

import pytest
from pyspark.sql import functions as F

from lossweave.functions import slots
from lossweave.operators import postings
from lossweave.operators.keyword import bm25_candidates
from lossweave.operators.postings import KeywordIndex, stored_candidates, write_postings
from tests.test_keyword_kernel import batch_of
from tests.test_search import QUERIES, brute_candidates


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(21)
    common, rare = ["der", "und", "Straße"], [f"wort{k}" for k in range(120)]
    words = lambda n: [*draw.choices(common, k=n), *draw.choices(rare, k=n)]
    documents = {f"c{i}": "Claim: " + " ".join(words(draw.randint(1, 12))) for i in range(240)}
    documents |= {"c900": "Claim: leak leak leak", "c901": "Claim: leak", "c902": "Claim: leak", "c903": "Claim: wort1 " + "leak " * 200}
    return documents


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    claims = spark.createDataFrame(list(corpus.items()), "claim_id string, document string")
    write_postings(claims.repartition(3), path, slot_claims=8, buckets=5)
    return KeywordIndex(spark, path, buckets=5)


def counts_of(rows):
    batch = batch_of(rows)
    return [batch.select(["claim_id", "dl", "terms", "tfs", "dls"])]


def hits_of(spark, index, rows, pool=100):
    hits, report = stored_candidates(index, spark.createDataFrame(rows, QUERIES), pool, first_slots=2)
    found = {}
    for r in hits.collect():
        found.setdefault(r.query_id, {})[r.claim_id] = r.bm25_score
    return found, {r.query_id: r for r in report.collect()}


def test_against_brute_force_and_without_needless_slots(spark, corpus, index):
    rows = [("a", "leak wort1", None), ("b", "der wort5 wort6 wort5", None), ("c", "claim", None), ("d", "claim STRASSE wort9", None), ("e", "nowhere", None), ("f", "", None)]
    for pool in (3, 100):
        found, report = hits_of(spark, index, rows, pool)
        for query_id, text, _ in rows:
            expected = brute_candidates(text, corpus, pool) if text else {}
            assert found.get(query_id, {}) == pytest.approx(expected), query_id
        assert report["d"].slots_read == report["d"].slots  # its terms occur in every claim: nothing proves a zero
    assert hits_of(spark, index, rows, 3)[1]["b"].slots_read < report["b"].slots


def test_pruning_reads_fewer_slots_the_better_the_first_ones_are(spark, index):
    _, report = hits_of(spark, index, [("a", "leak der", None)], 1)
    assert report["a"].slots_read <= 3 < report["a"].slots


def test_stored_claims_search_the_others(spark, corpus, index):
    ids = ["c0", "c17", "c902"]
    found, _ = hits_of(spark, index, [(i, corpus[i], i) for i in ids] + [("gone", corpus["c3"], "no such claim")], 20)
    for i in ids:
        others = {k: v for k, v in corpus.items() if k != i}
        assert found[i] == pytest.approx(brute_candidates(corpus[i], others, 20))
    assert found["gone"] == pytest.approx(brute_candidates(corpus["c3"], corpus, 20))


def test_as_the_search_over_texts(spark, corpus, index):
    claims = spark.createDataFrame(list(corpus.items()), "claim_id string, document string")
    queries = spark.createDataFrame([(f"q{k}", f"der wort{k} und wort{2 * k} leak", None) for k in range(15)], QUERIES)
    key = lambda r: (r.query_id, r.claim_id)
    ours = sorted(stored_candidates(index, queries, 10)[0].collect(), key=key)
    theirs = sorted(bm25_candidates(claims, queries, candidate_pool=10).collect(), key=key)
    assert [key(r) for r in ours] == [key(r) for r in theirs]
    assert [r.bm25_score for r in ours] == pytest.approx([r.bm25_score for r in theirs])


def test_blocks_are_bounded_and_searches_read_no_texts(spark, corpus, index):
    blocks = index.postings()
    most = index.slots().agg(F.max("size")).first()[0]
    assert blocks.agg(F.max(F.size("held"))).first()[0] <= most < 30
    assert "document" not in blocks.columns and index.postings(spark.createDataFrame([("leak",)], "term string")).select("bucket").distinct().count() == 1
    size = index.corpus_size().first()
    assert size.n_docs == len(corpus) and index.document_frequencies().where("term = 'claim'").first().df == len(corpus)


def test_without_claims_or_queries(spark, index, tmp_path):
    none = spark.createDataFrame([], "claim_id string, document string")
    write_postings(none, f"{tmp_path}/none")
    empty = KeywordIndex(spark, f"{tmp_path}/none")
    assert stored_candidates(empty, spark.createDataFrame([("a", "leak", None)], QUERIES))[0].count() == 0
    assert stored_candidates(index, spark.createDataFrame([], QUERIES))[0].count() == 0


def test_a_search_stores_rows_per_task_not_per_slot_or_claim(spark, tmp_path, monkeypatch):
    """Neither the headers of every slot nor the scores of every matching claim leave the tasks."""
    documents = [(f"c{i:04d}", f"der leak wort{i % 50} " + "und " * (i % 9)) for i in range(1600)]
    claims = spark.createDataFrame(documents, "claim_id string, document string")
    write_postings(claims.repartition(2), f"{tmp_path}/index", slot_claims=8, buckets=3)
    index, stored, write_once = KeywordIndex(spark, f"{tmp_path}/index", buckets=3), {}, postings.write_once

    def counted(frame, label, *rest):
        held = write_once(frame, label, *rest)
        stored[label] = held.count()
        return held

    monkeypatch.setattr(postings, "write_once", counted)
    for own in (None, "c0007"):
        found, _ = hits_of(spark, index, [("a", "der leak wort7", own), ("b", "der und", None)], 5)
        corpus = dict(documents)
        assert found["b"] == pytest.approx(brute_candidates("der und", corpus, 5))
        assert found["a"] == pytest.approx(brute_candidates("der leak wort7", {k: v for k, v in corpus.items() if k != own}, 5))
        tasks = 2 * spark.sparkContext.defaultParallelism
        assert index.slots().count() >= 200
        assert stored["query-slots"] <= tasks * 2 * 3 and stored["slot-scores"] <= tasks * 2 * (5 + 2), stored


def test_texts_of_one_id_and_slots_of_long_texts(spark, tmp_path, monkeypatch):
    claims = spark.createDataFrame([("1", "water leak"), ("2", "water"), ("2", "roof roof water"), ("3", "fire"), ("4", "")], "claim_id string, document string")
    write_postings(claims, f"{tmp_path}/index", buckets=2)
    index = KeywordIndex(spark, f"{tmp_path}/index", buckets=2)
    size = index.corpus_size().first()
    assert (size.n_docs, size.n_tokens) == (5, 7) and sorted((r.claim_id, r.dl) for r in index.lengths().collect()) == [("1", 2), ("2", 1), ("2", 3), ("3", 1), ("4", 0)]
    found, _ = hits_of(spark, index, [("a", "water roof", "2"), ("b", "water roof", None)])
    assert list(found["a"]) == ["1"] and found["b"]["2"] == 1.0 and set(found["b"]) <= {"1", "2"}
    batches = [b for n in (3, 40) for b in counts_of([(f"k{i}", {"a": 1, f"w{i}": 2}, 3) for i in range(n)])]
    for most in (1, 1 << 20):  # bytes at which a slot ends early
        monkeypatch.setattr(slots, "_SLOT_BYTES", most)
        rows = list(slots.deal_batches(batches, 8, 2, 1))
        dealt = [s for b in rows for s in b.column("ids").to_pylist()]
        assert sorted(sum(dealt, [])) == sorted(i for b in batches for i in b.column(0).to_pylist()) and max(map(len, dealt)) <= 8
        assert len({s for b in rows for s in b.column("slot").to_pylist()}) == len(dealt)


def test_pairs_of_slots_and_queries_as_whole_blocks(spark, corpus, index, monkeypatch):
    """Slots scored pair by pair give what slots scored for all queries give."""
    rows = [("a", "leak wort1", None), ("b", "der wort5 wort6", "c5"), ("c", "claim der", None)]
    found = {}
    for few in (0.0, 2.0):
        few_of = slots._FEW
        slots._FEW = few
        try:
            found[few] = hits_of(spark, index, rows, 4)[0]
        finally:
            slots._FEW = few_of
    assert found[0.0].keys() == found[2.0].keys()
    for query_id in found[0.0]:
        assert found[0.0][query_id] == pytest.approx(found[2.0][query_id])
