import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossweave.llm import registry
from lossweave.llm.periodic import SuffixTree, collapse_runs, planted, runs_of

SCHEMA = "doc_id long, text string"


def brute(words, least_length=6, exponent=4):
    found, n = set(), len(words)
    for q in range(1, n // exponent + 1):
        same = [words[k] == words[k + q] for k in range(n - q)]
        k = 0
        while k < len(same):
            if not same[k]:
                k += 1
                continue
            stop = k
            while stop < len(same) and same[stop]:
                stop += 1
            length = stop - k + q
            smaller = any(all(words[x] == words[x + p] for x in range(k, k + length - p)) for p in range(1, q) if q % p == 0)
            if length >= max(least_length, exponent * q) and not smaller:
                found.add((k, length, q))
            k = stop
    return sorted(found)


def test_runs_against_brute_force():
    draw = random.Random(1)
    for _ in range(1500):
        words = draw.choices("abc"[: draw.choice([1, 2, 2, 3])], k=draw.randint(0, 40))
        if draw.random() < 0.4 and words:
            words += (words[: draw.randint(1, 5)] * 9)[: draw.randint(1, 30)]
        for least, exponent in ((6, 4), (2, 2)):
            assert [tuple(r) for r in runs_of(words, least, exponent).tolist()] == brute(words, least, exponent)


def test_tree_against_brute_force():
    draw = random.Random(2)
    for size in (1, 2, 7, 60, 300):
        s = draw.choices([1, 2, 3], k=size)
        tree = SuffixTree(s)
        order = sorted(range(size + 1), key=lambda k: s[k:])
        assert [order[r] for r in tree.rank] == list(range(size + 1)) or tree.rank[order].tolist() == list(range(size + 1))
        pairs = [(a, b) for a in range(size + 1) for b in range(size + 1) if a != b]
        pairs = draw.sample(pairs, min(len(pairs), 2000))
        a, b = np.array(pairs).T

        def common(x, y):
            k = 0
            while max(x, y) + k < size and s[x + k] == s[y + k]:
                k += 1
            return k

        assert tree.lce(a, b).tolist() == [common(x, y) for x, y in pairs]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    return doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    vocabulary = [f"wörd{k}" for k in range(300)]
    rows = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 30, 120])))) for k in range(300)]
    rows += [(500 + k, "  ".join(draw.choices(["a", "b"], k=60)) + "\n" + "x y\tz " * draw.randint(1, 9)) for k in range(60)]
    rows += [(700, "la " * 400), (701, ("one two three " * 7 + "mid ") * 6), (702, "a" * 70_000 + " " + "b" * 70_000), (703, ("q" * 70_000 + " ") * 7)]
    return rows + [(None, "so so so so so so so"), (None, None), (9, "x " * 8), (9, "x " * 8), (800, ""), (801, " \n\t")]


def test_query_against_brute_force(spark, rows, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"runs": F.lit("r"), "a.b": F.lit(1), "kept": F.lit(0)})
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    got = registry.QUERIES["op13_periodic_runs"](spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_planted_ends_are_found_and_tables_may_be_empty(spark):
    prose = " ".join(f"w{k}" for k in range(400))
    found = collapse_runs(planted(spark.range(200).select(F.col("id").alias("doc_id"), F.lit(prose).alias("text"))))
    for r in found.collect():
        h = zlib.crc32(str(r.doc_id).encode())
        a, steps = h // 10 % 400, 3 + h // 10 % 8
        p = 1 + (400 - a) // steps
        has = h % 10 == 0 and 400 - a >= max(6, 4 * p)
        assert [(x.start, x.length, x.period) for x in r.runs] == ([(a, 400 - a, p)] if has else [])
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_very_long_periodic_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(120_000)) + " end"
    row = collapse_runs(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(0, 120_000, 5000)] and row.kept.split()[-1] == "end"
    assert row.n_words == 120_001 and len(row.kept.split()) == 5001
