import random

import numpy as np
import pytest

from lossweave.llm.decontamination import GAP, MATCH, MISMATCH, align, contaminated, decontaminate


def plain_alignment(item, region):
    before, best = [0.0] * (len(region) + 1), 0.0
    for word in item:
        now = [0.0]
        for j, other in enumerate(region, 1):
            step = MATCH if word == other else MISMATCH
            now.append(max(0.0, before[j - 1] + step, before[j] + GAP, now[-1] + GAP))
        best = max(best, *now)
        before = now
    return best


def test_alignment_against_plain_one():
    draw = np.random.default_rng(2)
    for _ in range(40):
        item = draw.integers(0, 4, 9).astype(np.uint64)
        regions = [draw.integers(0, 4, draw.integers(1, 25)).astype(np.uint64) for _ in range(5)]
        best, end = align(item, regions)
        assert best.tolist() == pytest.approx([plain_alignment(item.tolist(), r.tolist()) for r in regions])
        assert all(0 <= e <= len(r) for e, r in zip(end, regions))


def words(draw, count):
    return ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(count)]


@pytest.mark.parametrize("block_words", [500_000, 50])
def test_copies_are_found(spark, block_words):
    draw = random.Random(3)
    items = [words(draw, 30) for _ in range(6)]
    docs, expected = [], set()
    for i in range(60):
        text = words(draw, 120)
        if i % 3 == 0:  # a copy; a third of them are edited at every sixth word
            k = 0 if i % 2 else i % 6
            copy = [w if i % 9 or n % 6 else "edited" for n, w in enumerate(items[k])]
            text[40:40] = copy
            expected.add((i, k))
        elif i % 3 == 1:  # a short quotation is none
            text[10:10] = items[i % 6][:8]
        docs.append((i, " ".join(text).upper() + "."))
    docs += [(100, None), (101, ""), (None, " ".join(items[5]))]
    expected.add((None, 5))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(4)
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, "too short"), (0, " ".join(items[0]))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = contaminated(frame, benchmark, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    exact = next(r for r in found if r.doc_id == 3)
    assert (exact.score, exact.start_word, exact.end_word) == (1.0, 40, 70)
    clean = decontaminate(frame, benchmark)
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - {e[0] for e in expected}
    assert clean.columns == frame.columns
    assert contaminated(frame.limit(0), benchmark).count() == 0 and contaminated(frame, benchmark.limit(0)).count() == 0
