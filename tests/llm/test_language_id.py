import random

import numpy as np
import pytest

from lossweave.llm import language_id
from lossweave.llm.language_id import _padded, fit, gradients, identify, initial, label_runs


def test_gradients_against_differences():
    network = initial(["a", "b", "c"], 3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    runs = [b"abc", b"z", b"hello", b"\xc3\xa9t"]
    codes, sizes = _padded(runs)
    target, weight = np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 0.5, 1.0])
    loss, grad = gradients(network, codes, sizes, target, weight)
    draw = np.random.default_rng(3)
    for name, values in network.weights.items():
        places = [p for p in np.ndindex(values.shape) if name[0] != "x" or p[0] in codes]
        for place in [places[i] for i in draw.integers(0, len(places), 12)]:
            values[place] += 1e-4
            up = gradients(network, codes, sizes, target, weight)[0]
            values[place] -= 2e-4
            down = gradients(network, codes, sizes, target, weight)[0]
            values[place] += 1e-4
            assert (up - down) / 2e-4 == pytest.approx(grad[name][place], abs=2e-3)


def test_every_position_is_labelled():
    network = initial(["a", "b"], 4)
    data = np.frombuffer(b"x" * 100 + b"yz", np.uint8)
    sums = label_runs(network, data, np.array([0, 100]), np.array([100, 2]))
    assert sums.sum(axis=1) == pytest.approx([100, 2], rel=1e-4)
    apart = sum(label_runs(network, data, np.array([a]), np.array([min(24, 100 - a)])) for a in range(0, 100, 24))
    assert sums[0] == pytest.approx(apart[0], rel=1e-4)


def test_held_out_documents(spark):
    draw = random.Random(8)
    syllables = {"xx": ["ka", "to", "ri", "mu"], "yy": ["schl", "ein", "ung", "ö"], "zz": ["qu", "ée", "eaux", "ti"]}
    text = lambda lang: " ".join("".join(draw.choices(syllables[lang], k=draw.randint(1, 4))) for _ in range(40)) + ". 12"
    rows = [(i, text(lang), lang) for i, lang in enumerate(draw.choices(list(syllables), k=150))]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "12 -- ½!", "yy"), (None, text("zz"), "zz"), (902, "", None)], "doc_id long, text string, lang string")
    network = fit(docs, hidden=8)
    got = {r.doc_id: r for r in identify(docs.withColumn("score", docs.doc_id), network).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if language_id_fold(i) == 2]
    assert np.mean(right) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and got[None].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    assert fit(docs.limit(0)) is None and identify(docs.limit(0), network).count() == 0


def language_id_fold(number):
    import zlib

    return zlib.crc32(str(number).encode()) % 4
