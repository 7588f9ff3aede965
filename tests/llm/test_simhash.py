import random

import pytest
from pyspark.sql import functions as F

from lossweave.llm.simhash_trie import fingerprint, links, near_duplicates
from lossweave.llm.components import connected_components


def components(nodes, near):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("node_limit", [50_000, 3])
def test_trie_join_finds_all_components(spark, node_limit):
    draw = random.Random(5)
    values = set()
    for _ in range(12):
        seed = draw.getrandbits(64)
        values.add(seed)
        for _ in range(12):
            values.add(seed ^ sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 3, 4]))))
    values |= {0, 1, 3, 2**64 - 1, 2**63, 7 | 2**60}
    expected = components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    edges = links(spark.createDataFrame(signed, "fp long"), 2, node_limit)
    got = {r.node % 2**64: r.root % 2**64 for r in connected_components(edges).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(got) == {g for g in groups(expected) if len(g) > 1}
    assert all((r.u ^ r.v).bit_count() <= 2 for r in edges.collect() if (r.u < 0) == (r.v < 0))


def test_fingerprint_of_short_and_empty_texts():
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n\t") == 0
    assert fingerprint("A B") == fingerprint("a\x0bb") != 0
    assert fingerprint("É x y z") != fingerprint("é x y z")


def test_near_duplicates_rows(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text.upper()), (9, None), (7, ""), (8, "other words entirely here"), (None, text), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 7)]
    spark_side = docs.select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert fingerprint("a b c") == spark_side % 2**64
    assert near_duplicates(docs.limit(0)).count() == 0
