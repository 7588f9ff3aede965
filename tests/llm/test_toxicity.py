import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossweave.llm.toxicity import fit, score, segments_of


def best_sum(values):
    best = here = 0.0
    for v in values:
        here = max(0.0, here + v)
        best = max(best, here)
    return best


def recursive(values, shift=0):
    """All maximal segments by their definition: the best one, then those to its left and right."""
    total = np.append(0, np.cumsum(values))
    spans = [(total[j] - total[i], -i, -j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    top = max(spans, default=(0, 0, 0))
    if top[0] <= 1e-12:
        return []
    # of equal sums the shortest
    i, j = min(((-a, -b) for s, a, b in spans if s >= top[0] - 1e-12), key=lambda p: p[1] - p[0])
    return recursive(values[:i], shift) + [(i + shift, j - 1 + shift, top[0])] + recursive(values[j:], shift + j)


def test_segments_are_all_maximal_ones():
    draw = random.Random(1)
    for _ in range(300):
        size = draw.randint(1, 14)
        drift = 0.37
        values = [draw.choice([-drift, -drift, draw.uniform(-2, 2)]) for _ in range(size)]
        hits = [i for i, v in enumerate(values) if v != -drift]
        got = segments_of(np.array(hits, int), np.array([values[i] for i in hits]), drift)
        want = recursive(np.array(values))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])
        assert max((s for *_, s in got), default=0) == pytest.approx(best_sum(values))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(6)
    clean = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = draw.choices(clean, k=draw.randint(30, 200))
        toxic = i % 5 == 0
        if toxic:
            at = draw.randrange(len(words))
            words[at:at] = [draw.choice(["vilewordone", "vilewordtwo", "nastything"]) + draw.choice(["", ",", "x"]) for _ in range(4)]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents(spark, corpus):
    docs = spark.createDataFrame([r[:2] for r in corpus] + [(1000, None), (None, ""), (1001, "w1 " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in corpus] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = {r.doc_id: r for r in score(docs.withColumn("row", F.lit(1)), model).collect()}
    held = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 40 and all(got[i].predicted == t for i, _, t in held)
    assert got[1000].predicted == got[None].predicted == got[1001].predicted == 0
    toxic = next(r for r in held if r[2])
    [passage] = got[toxic[0]].passages
    assert {w[:4] for w in toxic[1][passage.start : passage.stop].split()} <= {"vile", "nast"}
    kept = score(docs.withColumn("row", F.lit(1)), model, keep=True).where("predicted = 0").select("row.*")
    assert kept.columns == ["doc_id", "text", "row"] and kept.count() == 403 - 80


def test_linear_time_over_many_hits():
    count = 1_000_000
    values = np.random.Generator(np.random.PCG64(1)).choice([0.4, -0.1, -0.35], count)
    for v in (values, np.tile([0.5, -0.2], count // 2), np.tile([0.2, -0.5], count // 2)):
        begin = time.process_time()
        found = segments_of(np.arange(count), v, 0.3)
        assert time.process_time() - begin < 15 and found == sorted(found)


def test_short_passages_in_long_texts_among_rare_toxic_rows(spark):
    draw = random.Random(8)
    prose, vile = [f"w{i}" for i in range(3000)], [f"vile{i}" for i in range(6)]
    rows = []
    for i in range(1500):
        words = draw.choices(prose, k=draw.choice([40, 300, 3000]) if i < 1450 else 4000)
        if toxic := i % 25 == 0:
            at = draw.randrange(len(words))
            words[at:at] = draw.choices(vile, k=3)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = score(docs, fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))).collect()
    assert all((r.predicted == 1) == (r.score >= 0.5) == bool(r.passages) for r in got)
    toxic = {r[0] for r in rows if r[2]}
    found = {r.doc_id for r in got if r.predicted}
    assert len(found & toxic) >= 0.95 * len(toxic) and len(found - toxic) <= 0.01 * len(rows)


def test_without_labels(spark, corpus):
    docs = spark.createDataFrame([r[:2] for r in corpus[:9]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 1e-9 for r in score(docs, fit(docs, none)).collect())
    assert score(docs.limit(0), fit(docs.limit(0), none)).count() == 0
