import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from lossweave.llm.mixing import mix, word_count

SCHEMA = "doc_id long, text string, source string"


def expected_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, target, left = set(names), {}, Fraction(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target | {s: weight[s] * level for s in open_}


def corpus(n, seed):
    draw = random.Random(seed)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 80, 81, 400])), draw.choice(["a", "b", "ç", "𝄞", "z", None, ""])) for i in range(n)]
    rows += [(n + i, "q " * 900, "tiny") for i in range(2)] + [(n + 9, None, "void"), (None, "x y", "a"), (None, "x y", "a")]
    return rows + [(7_000, "same words here", "b")] * 37


def check(rows, got, weights=(5, 2, 1), most=3):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
    target = expected_targets(sizes, weights, most)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, count(t)) for i, t, s in rows)
    taken, partial = defaultdict(int), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(target[r.source])) <= 1e-9 * max(1, r.target)
        assert 0 <= r.taken <= most * r["size"]
        whole = int(r.copies + 1e-12) * r["size"]
        assert whole <= r.taken <= whole + r["size"]
        partial[r.source] += bool(r["size"]) and r.taken % r["size"] != 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes) and all(v <= 1 for v in partial.values())


def test_contract_over_one_and_several_levels(spark):
    rows = corpus(600, 1)
    for chunk in (256, 3):
        check(rows, mix(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect())
    check(rows, mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 9), most=2).collect(), (1, 9), 2)


def test_reruns_agree_and_other_columns_do_not_matter(spark):
    rows = corpus(300, 2)
    key = lambda r: tuple(str(x) for x in r)
    one = sorted(mix(spark.createDataFrame(rows, SCHEMA)).collect(), key=key)
    docs = spark.createDataFrame(rows[::-1], SCHEMA).repartition(9).withColumns({"size": F.lit("s"), "a.b": F.lit(1), "taken": F.lit(2)})
    assert sorted(mix(docs).collect(), key=key) == one


def test_rounding_is_fair(spark):
    """Every document is taken as often as it is wanted, over many seeds."""
    rows = [(i, "w " * (10 * (i % 7 + 1)), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    total = Counter()
    for seed in range(0, 1000, 100):
        for r in mix(docs, seed=seed, chunk=8).collect():
            total[r.doc_id] += r.taken / r["size"] - r.copies
    assert max(abs(v) / 10 for v in total.values()) < 0.6 and abs(sum(total.values())) / 400 < 0.05


def test_long_texts_empty_tables_and_many_equal_rows(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.taken for r in mix(spark.createDataFrame([(1, None, None), (2, " \n", "a")], SCHEMA)).collect()} == {0}
    long_ = "ab\t\x0b cd  x " * 400_000
    counted = spark.createDataFrame([(long_,), (" \n\t",), ("é",), (None,)], "t string").select(word_count(F.col("t")).alias("n"))
    assert sorted(r.n for r in counted.collect()) == [0, 0, 1, 1_200_000]
    equal = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("t").alias("source"))
    found = mix(equal.union(other)).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert [(r.n, abs(r.taken - r.target) <= 1) for r in found.orderBy("source").collect()] == [(10_000, True), (300, True)]
