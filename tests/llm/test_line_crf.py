import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lossweave.llm import line_crf
from lossweave.llm.line_crf import Field, judge, log_likelihood, viterbi

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, earlier = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in earlier
            earlier.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, lines, len(inside), failed


def texts():
    draw = random.Random(4)
    bits = ["a", "b", "é", "ab.", "#|", "12", "\n", "\n\n", " ", "x\x0b", " ", "The", "</a>"]
    out = [" ".join(draw.choice(bits) for _ in range(draw.choice([0, 1, 4, 60, 130]))) for _ in range(60)]
    return out + ["", None, "\n", "one\ntwo\none\n one\n", "w " * 60, "\r\n a\r\n a\r\n", " ".join(f"w{i}" for i in range(80))]


def test_counts_against_brute_force(spark):
    cases = texts()
    docs = spark.createDataFrame(list(enumerate(cases)) + [(None, "no id")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[1:7]) for r in judge(docs, None).collect()}
    assert [got[i] for i in range(len(cases))] == [brute(t) for t in cases] and None in got
    assert judge(docs.limit(0), None).count() == 0


@pytest.fixture
def field():
    draw = np.random.default_rng(0)
    return Field(draw.normal(size=(3, 2)), draw.normal(size=(2, 2)), draw.normal(size=2))


def path_score(field, x, states):
    score = field.first[states[0]] + sum(x[t] @ field.lines[:, s] for t, s in enumerate(states))
    return score + sum(field.pairs[a, b] for a, b in zip(states, states[1:]))


def test_viterbi_and_likelihood_against_all_paths(field):
    draw = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    x = draw.normal(size=(11, 3))
    y = draw.integers(0, 2, 11)
    best, expected = viterbi(field, x, first, together=2), 0.0
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        paths = {p: path_score(field, x[a:b], p) for p in itertools.product((0, 1), repeat=b - a)}
        assert tuple(best[a:b]) == max(paths, key=paths.get)
        expected += paths[tuple(y[a:b])] - np.logaddexp.reduce(list(paths.values()))
    keep = np.array([0, 4, 5, 11])
    value, gradient = log_likelihood(field, x, y, keep)
    assert value == pytest.approx(expected)
    for name in ("lines", "pairs", "first"):
        for place in np.ndindex(getattr(field, name).shape):
            moved = Field(field.lines.copy(), field.pairs.copy(), field.first.copy())
            getattr(moved, name)[place] += 1e-6
            slope = (log_likelihood(moved, x, y, keep)[0] - value) / 1e-6
            assert slope == pytest.approx(getattr(gradient, name)[place], abs=1e-4)


def test_fitted_field_parts_prose_from_tables(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(8))
    table = lambda: "\n".join(" | ".join(word() for _ in range(9)) + " |" for _ in range(8))
    rows = [(i, prose() if i % 2 else table()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in judge(docs, line_crf.fit(docs, labels)).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(60))
    assert line_crf.fit(docs, labels.limit(0)) is None


def test_rights_words():
    got = line_crf.analyse(pa.array(["All rights reserved.\nplain line here\nLICENSED, under"]))
    assert got.features[:, line_crf.FEATURES.index("rights")].tolist() == [1, 0, 1]
