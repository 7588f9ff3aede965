"""Quality rules: plain counts, then a linear-chain conditional random field over the lines of a text.

Counts (whole texts, words ``[^\\x20\\x09-\\x0D]+``): words, code points in words, characters of
``[#*$%&|<>]``, lines with a word that equal an earlier line, and words inside 3-word windows that occur twice
or more in the text. A text fails the base rules with under 50 words, or if over half of its words stand in
repeated windows.

Field: each line with a word is a state, content or boilerplate, with binary features of its words, characters
and place. The field is fitted (numpy, gradient of the log-likelihood by forward and backward sums, Adam) on a
bounded sample of labelled documents of each quality: lines of good documents are content, unless they repeat
inside the document or speak of licences and rights; lines of poor documents are boilerplate. Viterbi decoding
marks the lines of every text, and a text is kept if content lines hold at least ``least_share`` of its words.

Defined results: null text has no words and fails; rows are judged one by one, so repeated rows give repeated
results and null ids are kept; without labelled documents of both qualities all lines count as content; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.arrays import _BYTES, mix, pieces, prefix_sums, stretch_hashes, text_bytes, window_hashes, word_bounds, word_hashes

RIGHTS = ("license", "licensed", "licence", "copyright", "rights", "reserved", "permission", "warranty")
FEATURES = (
    "always", "under 3 words", "3 to 7 words", "8 to 20 words", "over 20 words", "symbols over 2 %", "symbols over 10 %",
    "digits over 10 %", "capitals over 30 %", "a bar", "3 bars or more", "ends a sentence", "a word repeats the last",
    "over half of the words repeat the last", "line repeats", "short words", "long words", "first line", "last line", "rights",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars.encode())] = 1
    return out


_SYMBOLS, _BARS = _class("#*$%&|<>"), _class("|")
_DIGITS, _CAPITALS = _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_POINT = np.array([not 0x80 <= b < 0xC0 for b in range(256)], np.int32)  # first byte of a code point
_STOP = _class(".!?") > 0


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: whether it occurs twice or more, and whether an equal one came before."""
    order = np.argsort(keys, kind="stable")
    same = np.append(False, keys[order][1:] == keys[order][:-1])
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order] = same
    twice[order] = same | np.append(same[1:], False)
    return twice, before


@dataclass
class Texts:
    """Counts and line features of some texts; ``line_first`` and ``line_words`` are per row and per line."""

    counts: dict[str, np.ndarray]
    features: np.ndarray
    line_first: np.ndarray
    line_words: np.ndarray


def analyse(column: pa.Array) -> Texts:
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    in_words = np.zeros(len(data) + 1, np.int32)
    np.add.at(in_words, starts, 1)
    np.add.at(in_words, ends, -1)
    points = _sums(_POINT[data] * np.cumsum(in_words)[:-1])
    symbols = _sums(_SYMBOLS[data])

    triples = window_hashes(words, 3)
    inside = row_of[: len(triples)] == row_of[2:] if len(triples) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice, _ = _seen(mix(triples[at] ^ mix(row_of[at].astype(np.uint64))))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    repeated = _sums(np.cumsum(edge)[:-1] > 0)

    # lines: cut at line breaks and at the texts' bounds; only those with a word count
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = np.where(data[stop - 1] == 0x0A, stop - 1, stop) if len(stop) else stop
    word_at = np.searchsorted(starts, begin)
    n_words = np.searchsorted(starts, stop) - word_at
    has = n_words > 0
    begin, stop, word_at, n_words = begin[has], stop[has], word_at[has], n_words[has]
    row = row_of[word_at] if len(word_at) else np.zeros(0, np.int64)
    keys = stretch_hashes(prefix_sums(_BYTES[data]), begin, stop - begin) ^ mix(row.astype(np.uint64))
    line_twice, line_before = _seen(keys)
    line_first = np.searchsorted(row, np.arange(rows + 1))

    size = np.maximum(ends[word_at + n_words - 1] - starts[word_at], 1) if len(word_at) else n_words
    share = lambda of: (s := _sums(of[data]))[stop] - s[begin]
    bars = share(_BARS)
    equal = _sums(np.append(False, words[1:] == words[:-1]))
    echoes = equal[word_at + n_words] - equal[np.minimum(word_at + 1, len(words))]
    rights = _sums(np.isin(_folded(data, starts, ends), _rights()))
    letters = (points[stop] - points[begin]) / np.maximum(n_words, 1)
    place = np.arange(len(row))
    columns = (
        np.ones(len(row)), n_words < 3, (n_words >= 3) & (n_words < 8), (n_words >= 8) & (n_words <= 20), n_words > 20,
        share(_SYMBOLS) > 0.02 * size, share(_SYMBOLS) > 0.1 * size, share(_DIGITS) > 0.1 * size, share(_CAPITALS) > 0.3 * size,
        bars > 0, bars > 2, _STOP[data[ends[word_at + n_words - 1] - 1]] if len(row) else row, echoes > 0, 2 * echoes > n_words,
        line_twice, letters < 3, letters > 10, place == line_first[row], place == line_first[row + 1] - 1,
        rights[word_at + n_words] > rights[word_at],
    )
    counts = {
        "n_words": np.diff(first),
        "word_chars": np.diff(points[offsets]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.diff(_sums(line_before)[line_first]),
        "n_repeat_words": np.diff(repeated[first]),
    }
    return Texts(counts, np.column_stack(columns).astype(np.float32), line_first, n_words)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words without capitals and without a last mark of punctuation."""
    mark = _class(".,;:!?)") > 0
    trimmed = np.where((ends - starts > 1) & mark[data[ends - 1]], ends - 1, ends) if len(ends) else ends
    return word_hashes(_LOWER[data], starts, trimmed)


def _rights() -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(RIGHTS)]))
    return word_hashes(data, *word_bounds(data, offsets)[:2])


@dataclass
class Field:
    lines: np.ndarray  # (features, 2)
    pairs: np.ndarray  # (2, 2), from a state to the next
    first: np.ndarray  # (2,)


def _padded(scores: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line scores of the picked rows as (time, rows, states), which cells are real, and their lines."""
    sizes = first[pick + 1] - first[pick]
    time = np.arange(sizes.max(initial=0))[:, None]
    real = time < sizes
    line = np.minimum(first[pick] + time, max(0, len(scores) - 1))
    return scores[line], real, line


def log_likelihood(field: Field, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[float, Field]:
    """Of the state sequences ``y`` of all rows, with its gradient."""
    scores, real, line = _padded(x @ field.lines, first, np.arange(len(first) - 1))
    steps = len(scores)
    ahead = np.zeros_like(scores)
    back = np.zeros_like(scores)
    add = np.logaddexp.reduce
    for t in range(steps):
        fresh = field.first + scores[0] if t == 0 else add(ahead[t - 1][:, :, None] + field.pairs, axis=1) + scores[t]
        ahead[t] = fresh if t == 0 else np.where(real[t][:, None], fresh, ahead[t - 1])
    for t in range(steps - 2, -1, -1):
        fresh = add(field.pairs + (scores[t + 1] + back[t + 1])[:, None, :], axis=2)
        back[t] = np.where(real[t + 1][:, None], fresh, 0)
    total = add(ahead[-1], axis=1)
    state = np.exp(ahead + back - total[:, None]) * real[:, :, None]
    gold = np.eye(2)[y[line]] * real[:, :, None]
    d_lines = np.zeros_like(field.lines, dtype=float)
    d_lines += x[line[real]].T @ (gold - state)[real]
    both = real[1:]
    edge = np.exp(ahead[:-1, :, :, None] + field.pairs + (scores[1:] + back[1:])[:, :, None, :] - total[:, None, None])
    d_pairs = (gold[:-1, :, :, None] * gold[1:, :, None, :] - edge * both[:, :, None, None]).sum((0, 1))
    value = float((scores * gold).sum() + (gold[0] * field.first).sum() - total.sum())
    value += float((gold[:-1, :, :, None] * gold[1:, :, None, :] * field.pairs).sum())
    return value, Field(d_lines, d_pairs, (gold[0] - state[0]).sum(0))


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 120, ridge: float = 1.0) -> Field:
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2))
    parts = ("lines", "pairs", "first")
    mean, square = ({p: np.zeros_like(getattr(field, p)) for p in parts} for _ in range(2))
    for step in range(1, rounds + 1):
        _, gradient = log_likelihood(field, x, y, first)
        for p in parts:
            g = (getattr(gradient, p) - ridge * getattr(field, p)) / max(1, len(x))
            mean[p] = 0.9 * mean[p] + 0.1 * g
            square[p] = 0.99 * square[p] + 0.01 * g**2
            pace = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            setattr(field, p, getattr(field, p) + pace * mean[p] / (np.sqrt(square[p]) + 1e-9))
    return field


def viterbi(field: Field, x: np.ndarray, first: np.ndarray, together: int = 64) -> np.ndarray:
    """The most likely state of every line; 1 is content. Of equally likely ones content wins."""
    out = np.zeros(len(x), np.int64)
    scores = x @ field.lines
    rows = np.argsort(np.diff(first), kind="stable")
    rows = rows[np.diff(first)[rows] > 0]
    for at in range(0, len(rows), together):
        cells, real, line = _padded(scores, first, rows[at : at + together])
        steps = len(cells)
        best, came = field.first + cells[0], np.zeros(cells.shape, np.int8)
        for t in range(1, steps):
            to = best[:, :, None] + field.pairs
            came[t] = to[:, 1] >= to[:, 0]
            best = np.where(real[t][:, None], to.max(axis=1) + cells[t], best)
        state = (best[:, 1] >= best[:, 0]).astype(np.int64)
        for t in range(steps - 1, -1, -1):
            out[line[t][real[t]]] = state[real[t]]
            if t:
                state = np.where(real[t], came[t][np.arange(len(state)), state], state)
    return out


def fit(docs: DataFrame, labels: DataFrame, documents: int = 400, most_lines: int = 200) -> Field | None:
    """Fit on at most so many labelled documents of each quality (in the order of a hash); long documents
    enter in stretches of ``most_lines`` lines."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    by_hash = [F.xxhash64("id"), "id"]
    sample = known.where("quality = 1").orderBy(*by_hash).limit(documents)
    sample = sample.unionByName(known.where("quality = 0").orderBy(*by_hash).limit(documents))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), body).join(F.broadcast(sample), "id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = analyse(piece.column("text"))
                bits = (texts.features.astype(np.int64) << np.arange(len(FEATURES))).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(texts.line_first.astype(np.int32)), pa.array(bits))
                yield pa.RecordBatch.from_arrays([piece.column("quality"), lists], names=["quality", "lines"])

    rows = [r for r in chosen.mapInArrow(run, "quality int, lines array<long>").collect() if r["lines"]]
    if len({r.quality for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.quality, len(r["lines"]), r["lines"]))
    bits = [np.array(r["lines"][i : i + most_lines]) for r in rows for i in range(0, len(r["lines"]), most_lines)]
    good = [r.quality for r in rows for i in range(0, len(r["lines"]), most_lines)]
    first = np.append(0, np.cumsum([len(b) for b in bits]))
    x = ((np.concatenate(bits)[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
    poor = x[:, FEATURES.index("line repeats")] + x[:, FEATURES.index("rights")] > 0
    y = (np.repeat(good, np.diff(first)) == 1) & ~poor
    return train(x, y.astype(np.int64), first)


def judge(docs: DataFrame, field: Field | None, least_share: float = 0.5) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, content_share, content_lines): ``content_lines`` are the numbers
    of the content lines among the lines with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                texts = analyse(piece.column("text"))
                state = viterbi(field, texts.features, texts.line_first) if field else np.ones(len(texts.line_words), np.int64)
                content = np.diff(_sums(texts.line_words * state)[texts.line_first])
                c = texts.counts
                share = content / np.maximum(c["n_words"], 1)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                marked = np.flatnonzero(state)
                row = np.searchsorted(texts.line_first, marked, "right") - 1
                bounds = np.searchsorted(row, np.arange(piece.num_rows + 1))
                lines = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((marked - texts.line_first[row]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed),
                     pa.array(~failed & (share >= least_share)), pa.array(share), lines],
                    names=["doc_id", *c, "base_failed", "kept", "content_share", "content_lines"],
                )

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"doc_id long, {counts}, base_failed boolean, kept boolean, content_share double, content_lines array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body).mapInArrow(run, schema)
