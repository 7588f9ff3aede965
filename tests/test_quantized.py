import numpy as np
import pytest
from pyspark.sql import functions as F

from lossweave.functions.vectors import unit_rows
from lossweave.operators import quantized as qz, semantic as sem


def vectors(rows, groups, seed, noise=0.5, width=32):
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = draw.normal(size=(groups, width))
    return centres[np.arange(rows) % groups] + noise * draw.normal(size=(rows, width))


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(vectors(1500, 15, 1))]
    rows += [(f"copy{i}", rows[7][1]) for i in range(40)] + [("none", None)]
    return spark.createDataFrame(rows, "claim_id string, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, claims, tmp_path_factory):
    quantizer = qz.fit_quantizer(claims, cells=20, parts=8, codes=32)
    path = str(tmp_path_factory.mktemp("cells"))
    qz.write_cells(claims, quantizer, path)
    return qz.CellIndex(spark, path, quantizer)


def test_every_claim_is_indexed_once_and_codes_stand_for_it(claims, index):
    rows = index.table().collect()
    assert sorted(r.claim_id for r in rows) == sorted(r.claim_id for r in claims.where("embedding is not null").collect())
    unit = unit_rows(np.array([r.embedding for r in rows]))
    cells = np.array([r.cell for r in rows])
    assert (cells == index.quantizer.cells(unit)).all()
    codes = np.array([list(r.code) for r in rows], np.uint8)
    assert codes.shape == (len(rows), 8)
    near = np.vstack([index.quantizer.look_up(codes[k : k + 1], cells[k]) for k in range(len(rows))])
    left = ((unit - near) ** 2).sum(axis=1).mean()
    assert left < 0.75 * ((unit - index.quantizer.centres[cells]) ** 2).sum(axis=1).mean()  # better than the cell alone


def test_recall_and_exact_distances(claims, index):
    queries = claims.where("claim_id < 'c0060'").select(F.col("claim_id").alias("query_id"), "embedding")
    hits, scored = qz.cell_candidates(index, queries, 10, n_probes=5, candidates=60)
    exact = sem.nearest_claims(claims, queries, 10)
    found = qz.recall(hits, exact).collect()
    assert len(found) == 60 and all(r.expected == 10 for r in found) and np.mean([r.recall for r in found]) >= 0.9
    assert scored.first().scored_fraction < 0.5
    right = {(r.query_id, r.claim_id): r.distance for r in exact.collect()}
    assert all(abs(right[k] - r.distance) < 1e-9 for r in hits.collect() if (k := (r.query_id, r.claim_id)) in right)


def test_all_cells_and_candidates_give_the_exact_search(claims, index):
    queries = claims.where("claim_id in ('c0003', 'c0007', 'c1400')").select(F.col("claim_id").alias("query_id"), "embedding")
    hits, scored = qz.cell_candidates(index, queries, 12, n_probes=20, candidates=2000)
    key = lambda df: sorted((r.query_id, r.claim_id) for r in df.collect())
    assert key(hits) == key(sem.nearest_claims(claims, queries, 12)) and scored.first().scored_fraction == 1.0


def test_small_and_empty_inputs(spark, tmp_path):
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "claim_id string, embedding array<double>")
    quantizer = qz.fit_quantizer(few, cells=64, parts=16)
    qz.write_cells(few, quantizer, str(tmp_path / "few"))
    index = qz.CellIndex(spark, str(tmp_path / "few"), quantizer)
    hits, _ = qz.cell_candidates(index, few.select(F.col("claim_id").alias("query_id"), "embedding"), 1)
    assert {(r.query_id, r.claim_id) for r in hits.collect()} >= {("a", "a"), ("b", "b")}
    none = spark.createDataFrame([], "query_id string, embedding array<double>")
    assert qz.cell_candidates(index, none, 3)[0].count() == 0
    with pytest.raises(ValueError):
        qz.fit_quantizer(few.where("false"))
