import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lossweave.llm import recompression, registry, suffix_dedup
from lossweave.llm.arrays import mix, text_bytes, word_bounds, word_hashes


def texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    long_ = " ".join(word() for _ in range(400))
    out = []
    for k in range(24):
        own = " ".join(word() for _ in range(draw.randint(0, 120)))
        cut = draw.randint(0, 40)
        out.append([own, own + " " + passage, passage[cut:] + "\n" + own, own + passage[:-cut or None] + own, long_[cut * 3 :]][k % 5])
    out += ["", None, "x" * 950, "x" * 1200, "ab" * 700, "a b " * 500, "c c " * 9 + "d", " ".join(["w"] * 70), long_, long_, "short"]
    out.append(long_ + " " + passage + " " + long_)
    return out


def brute_bytes(all_texts, match):
    data = [(t or "").encode() for t in all_texts]
    seen = Counter(d[i : i + match] for d in data for i in range(len(d) - match + 1))
    rows = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - match + 1):
            if seen[d[i : i + match]] > 1:
                gone[i : i + match] = b"\1" * match
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        rows.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return rows


@pytest.mark.parametrize("match", [100, 400])
def test_bytes_against_brute_force(spark, match):
    cases = texts()
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(3)
    got = {}
    for r in suffix_dedup.remove_repeats(docs, match, batches=5).collect():
        size = len((r.text or "").encode())
        got[r.doc_id] = (size, size - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
    assert [got[i] for i in range(len(cases))] == brute_bytes(cases, match)
    assert any(0 < g[1] < g[0] for g in got.values())


def test_planted_passages_go_by_their_bytes(spark, tmp_path):
    """Passages of 51 to 80 words in two documents each: 400 bytes decide, not the number of words."""
    draw = random.Random(17)
    words = lambda n: " ".join("".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 8))) for _ in range(n))
    passages = [words(draw.randint(51, 80)) for _ in range(20)]
    # other bytes next to each copy: no repeated string is longer than the passage
    cases = [f"{words(90)} {mark}{p}{mark} {words(90)}" for p in passages for mark in "XY"]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = registry.QUERIES["op3_suffix_dedup"](spark, folder).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_bytes(cases, 400)
    sizes = [len(p.encode()) for p in passages for _ in "XY"]
    assert [r.n_removed for r in got] == [size if size >= 400 else 0 for size in sizes]
    assert 0 < sum(size >= 400 for size in sizes) < len(sizes)


def brute_words(all_texts, window):
    docs = [(t or "").encode().split() for t in all_texts]
    first, rows = {}, []
    for d, words in enumerate(docs):
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (d, i))
    for d, words in enumerate(docs):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
    return rows


def test_words_against_brute_force(spark):
    cases = texts()
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in recompression.remove_repeats(docs, 20).collect()}
    assert [got[i] for i in range(len(cases))] == brute_words(cases, 20)
    assert any(0 < g[1] < g[0] for g in got.values())


def test_odd_tables(spark):
    same = "z" * 500
    rows = [(1, same, "a"), (1, same, "b"), (None, "y " * 300, "c"), (None, None, "d"), (2, "plain", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    cut = {(r.doc_id, r.text): bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[1, same] == b"" and cut[2, "plain"] == b"plain" and cut[None, None] == b"" and len(cut) == 4
    words = recompression.remove_repeats(docs).collect()
    assert len(words) == 5 and {r.n_words for r in words} == {1, 300, 0}
    empty = docs.limit(0)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and recompression.remove_repeats(empty).count() == 0


def test_long_words_differ_after_65536_bytes():
    data = ("a" * 70_000 + " " + "a" * 69_999 + "b" + " " + "a" * 70_000 + " b").encode()
    starts, ends, _ = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hashes = word_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3
    swapped = ("a" * 65_536 + "b" + "c" * 65_535 + " " + "b" + "a" * 65_535 + "a" + "c" * 65_535).encode()
    starts, ends, _ = word_bounds(np.frombuffer(swapped, np.uint8), np.array([0, len(swapped)]))
    assert len(set(word_hashes(np.frombuffer(swapped, np.uint8), starts, ends).tolist())) == 2


def test_long_texts_are_cut_in_parts_with_the_same_keys():
    draw = random.Random(9)
    words = [f"w{draw.randint(0, 40)}" for _ in range(3000)]
    text = " ".join(words + words[100:400] + words).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])

    def keys(part_words):
        row, starts, anchors, counts, key, _ = recompression.cut_segments(20, part_words)(data, offsets)
        assert (row == 0).all()
        return {int(s) + k: (int(a), int(h)) for s, a, c, h in zip(starts, anchors, counts, key) for k in range(c)}

    assert keys(1 << 22) == keys(700) == keys(64)


def _keys_of_windows(words, window=20):
    """Per window: content, anchor's distance from the window's start, key."""
    first = np.zeros(len(words), bool)
    first[0] = True
    number, place, key = recompression.anchors(words, first, window)
    return [(tuple(words[i : i + window].tolist()), int(place[i]) - i, int(key[i])) for i in range(len(key))]


@pytest.mark.parametrize("letters", [1, 2, 3, 12, 400])
def test_equal_windows_have_equal_symbols(letters):
    draw = np.random.default_rng(letters)
    shared = draw.integers(0, letters, 45)
    parts = []
    for _ in range(60):
        parts += [draw.integers(0, letters, draw.integers(0, 30)), shared[draw.integers(0, 20) :], np.repeat(draw.integers(0, letters), draw.integers(0, 30))]
    words = mix(np.concatenate(parts).astype(np.uint64))
    seen = {}
    for content, anchor, key in _keys_of_windows(words):
        assert seen.setdefault(content, (anchor, key)) == (anchor, key)
        assert 0 <= anchor < 20
    if letters == 400:  # keys tell windows apart: hardly any window has a key of other windows' content
        assert len({k for _, k in seen.values()}) > len(seen) / 10


def test_repeats_are_found_by_the_symbols_names(monkeypatch):
    draw = np.random.default_rng(5)
    passage = draw.integers(0, 300, 80)
    words = mix(np.concatenate([passage, draw.integers(0, 300, 200), passage]).astype(np.uint64))

    def shared():
        keys = {}
        for content, _, key in _keys_of_windows(words):
            keys.setdefault(content, []).append(key)
        return [len(set(k)) == 1 for k in keys.values() if len(k) > 1]

    assert len(shared()) == 61 and all(shared())
    monkeypatch.setattr(recompression, "pair_names", lambda left, right, number: draw.integers(1, 2**62, len(left)).astype(np.uint64))
    assert sum(shared()) < 61 // 2  # what is left are stretches without a pair


def test_words_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        columns = "doc_id, n_words, n_removed, kept_sha256"
        expected = db.sql(f"SELECT {columns} FROM ({registry.ORACLE['op5_recompression']}) ORDER BY doc_id").fetchall()
    got = registry.QUERIES["op5_recompression"](spark, folder).selectExpr(*columns.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected and sum(r.n_removed for r in got) > 0


def test_least_in_ranges_is_the_leftmost():
    draw = np.random.default_rng(4)
    values = draw.integers(0, 9, 300).astype(np.uint64)
    low = draw.integers(0, 280, 500)
    high = np.minimum(low + draw.integers(1, 30, 500), len(values))
    assert recompression.least_in(values, low, high).tolist() == [a + int(np.argmin(values[a:b])) for a, b in zip(low, high)]
    assert len(recompression.least_in(values, low[:0], high[:0])) == 0


@pytest.mark.parametrize("stretches", [recompression._word_stretches, suffix_dedup._byte_stretches])
def test_stretches_of_many_texts_at_once(stretches):
    texts = ["one two  three four", "", "two three four five", " one two"]
    joined = text_bytes(pa.array(texts))
    spans = [(0, 0, 3), (2, 1, 2), (3, 0, 2), (0, 1, 2), (2, 0, 1)]
    row, starts, lengths = (np.array(x) for x in zip(*spans))
    together = stretches(*joined, row, [(starts, lengths), (starts, lengths - 1)])
    for k, less in enumerate((0, 1)):
        alone = [stretches(*text_bytes(pa.array([texts[r]])), np.array([0]), [(np.array([s]), np.array([n - less]))])[0][0] for r, s, n in spans]
        assert together[k].tolist() == alone


def test_anchors_look_once_at_each_symbol(monkeypatch):
    """Windows whose anchor stands in the highest level are not searched in the levels below, nor hashed."""
    asked = []
    least_in = recompression.least_in
    monkeypatch.setattr(recompression, "least_in", lambda values, low, high: asked.append(len(low)) or least_in(values, low, high))
    words = np.random.default_rng(5).integers(1, 2**60, 4000).astype(np.uint64)
    recompression.anchors(words, np.arange(4000) == 0, 20)
    assert asked[0] > 3900 and sum(asked[1:]) < 100
