import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lossweave.functions.vectors import Balls, nearest_batches, rounded, unit_rows
from lossweave.operators import semantic as sem


def planted(rows, groups, seed, noise=0.05):
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = draw.normal(size=(groups, 16))
    return unit_rows(centres[np.arange(rows) % groups] + noise * draw.normal(size=(rows, 16)))


def store(path, ids, matrix, bound, bound_id=None):
    (path / "slot=0").mkdir()
    table = pa.table({"query_id": ids, "embedding": [v.tolist() for v in matrix], "bound": bound, "bound_id": pa.array(bound_id or [None] * len(ids), pa.string())})
    pq.write_table(table, path / "slot=0" / "part.parquet")
    return str(path)


def batch_of(ids, matrix):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tolist() for v in matrix])], names=["claim_id", "embedding"])


def brute(matrix, ids, queries, n):
    out = {}
    for k, q in enumerate(queries):
        distance = rounded(1.0 - matrix @ q)
        out[f"q{k}"] = [(ids[i], distance[i]) for i in sorted(range(len(ids)), key=lambda i: (distance[i], ids[i]))[:n]]
    return out


def test_one_task_emits_n_rows_per_query_however_many_chunks(tmp_path):
    matrix = planted(3000, 30, 1)
    matrix[2500:] = matrix[:500]  # ties across chunks
    ids = [f"c{(7 * i) % 3000:04d}" for i in range(3000)]
    queries = planted(12, 6, 2)
    path = store(tmp_path, [f"q{k}" for k in range(12)], queries, np.full(12, np.inf))
    batches = [batch_of(ids[a : a + 100], matrix[a : a + 100]) for a in range(0, 3000, 100)]
    for hold in (1 << 30, 40_000):
        hits = pa.Table.from_batches(nearest_batches(iter(batches), path, 1, 5, False, hold=hold)).to_pylist()
        assert len(hits) == 60
        got = {}
        for h in sorted(hits, key=lambda h: (h["query_id"], h["distance"], h["claim_id"])):
            got.setdefault(h["query_id"], []).append((h["claim_id"], h["distance"]))
        want = brute(matrix, ids, queries, 5)
        assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items()}


def test_bounds_and_balls_leave_out_far_groups(tmp_path):
    matrix, queries = planted(8000, 40, 3), planted(40, 40, 3)
    ids = [f"c{i:05d}" for i in range(8000)]
    want = brute(matrix, ids, queries, 5)
    bound = np.array([v[-1][1] for v in brute(matrix[::7], ids[::7], queries, 5).values()])
    path = store(tmp_path, [f"q{k}" for k in range(40)], queries, bound)
    seen = []
    hits = pa.Table.from_batches(nearest_batches([batch_of(ids, matrix)], path, 1, 5, False, seen=seen)).to_pylist()
    assert {(h["query_id"], h["claim_id"]) for h in hits} == {(q, c) for q, v in want.items() for c, _ in v}
    assert sum(seen) < 0.1 * 8000 * 40


def test_bounds_of_balls_hold():
    matrix = planted(2000, 7, 5, noise=0.6)
    matrix[5] = 0
    queries = np.vstack([planted(20, 5, 6), np.zeros((1, 16))])
    balls = Balls(matrix)
    least = balls.least(queries)
    for g, members in enumerate(balls.members):
        assert (least[:, g] <= (1.0 - matrix[members] @ queries.T).min(axis=0)).all()
    assert sorted(np.concatenate(balls.members)) == list(range(2000))


def test_search_with_and_without_first_bounds(spark):
    matrix = planted(600, 12, 8)
    rows = [(f"c{i:03d}", v.tolist(), i % 4) for i, v in enumerate(matrix)] + [("none", None, 0)]
    claims = spark.createDataFrame(rows, "claim_id string, embedding array<double>, cell int").repartition(5)
    queries = claims.where("embedding is not null and claim_id < 'c050'").select(F.col("claim_id").alias("query_id"), "embedding")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    plain = key(sem.nearest_claims(claims, queries, 7, sample=0))
    assert len(plain) == 350 and plain == key(sem.nearest_claims(claims, queries, 7, sample=100))
    probes = queries.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cell"))
    celled = key(sem.nearest_claims(claims, queries, 7, cell="cell", probes=probes, sample=0))
    assert celled == key(sem.nearest_claims(claims, queries, 7, cell="cell", probes=probes, sample=50))
    seen = claims.where("cell in (1, 2)")
    assert celled == key(sem.nearest_claims(seen, queries, 7, sample=0))


def test_copies_as_far_as_the_bound_count_by_their_ids(tmp_path):
    """A third of all claims are one vector: of its copies only those up to the bound's id can be among the best."""
    matrix = planted(900, 9, 11)
    matrix[::3] = matrix[0]
    ids = [f"c{i:04d}" for i in range(900)]
    queries = np.vstack([matrix[:1]] * 20)
    path = store(tmp_path, [f"q{k:02d}" for k in range(20)], queries, np.zeros(20), ["c0030"] * 20)
    late = nearest_batches([batch_of(ids[450:], matrix[450:])], path, 1, 5, False)
    assert sum(b.num_rows for b in late) == 0  # all copies of this task come later
    hits = pa.Table.from_batches(nearest_batches([batch_of(ids[:450], matrix[:450])], path, 1, 5, False)).to_pylist()
    assert {h["claim_id"] for h in hits} == {"c0000", "c0003", "c0006", "c0009", "c0012"} and len(hits) == 100


def test_emitted_hits_do_not_grow_with_tasks(spark):
    matrix = planted(4000, 8, 12, noise=0.4)
    matrix[::3] = matrix[0]
    claims = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(matrix)], "claim_id string, embedding array<double>")
    queries = claims.limit(60).select(F.col("claim_id").alias("query_id"), "embedding")
    counts = []
    for tasks in (2, 60):
        laid = claims.repartition(tasks, "claim_id").cache()
        asked = sem.first_bounds(laid, queries, 60, 5, False, 4096, 256)
        counts.append(sem._task_hits(laid, asked, 60, 5, False, 4096).count())
    assert counts[1] <= 60 * 5 * sem.STEP * 2 and counts[1] < 60 * 5 * 60 / 2
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(sem.nearest_claims(claims, queries, 5, sample=0)) == key(sem.nearest_claims(claims.repartition(30), queries, 5, sample=64))
