"""Removal of repeated word windows by recompression.

Texts are sequences of words ``[^\\x20\\x09-\\x0D]+``. A round of recompression first replaces each run of one
symbol by a symbol for (symbol, length), then splits the alphabet in two halves by a hash of the symbol and
replaces each pair (left half, right half) by a new symbol. A new symbol's name is a hash of the round and of
what it stands for, so equal substrings get equal names in every task without a shared dictionary.

What a round does inside a window depends on the window alone, but for the symbols at its two edges: of a run
at an edge the length is unknown, of a right half at the left edge (a left half at the right edge) whether it
is paired. Every window therefore has a range of *interior* symbols per level, which all equal windows share.
A symbol's signature takes in the signatures of its neighbours of the level below, which are interior wherever
it is: after two rounds some eight words. The interior symbol with the least signature, of the highest level
that has one, is the window's anchor and its signature the key; windows that follow each other with one anchor
are a segment.

Spark counts the keys over all texts: only windows in segments with a shared symbol can be repeated. It then
names the shared stretches by their whole content, and verifies what is left window by window
(``repeats.covered``). Of equal windows the first stays (smallest id, then smallest start).

Defined results: null text has no words; rows that share an id and a text are one document; null ids come
first in the order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm import repeats
from lossweave.llm.arrays import U64, mix, prefix_sums, stretch_hashes, window_hashes, word_bounds, word_hashes
from lossweave.llm.tables import drop, pin

ROUNDS = 2  # a symbol of the second level is interior to nearly every window of twenty words
_RUN, _PAIR = U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)
_NONE = U64(2**64 - 1)


def run_names(symbols: np.ndarray, lengths: np.ndarray, number: int) -> np.ndarray:
    """Names of runs; a run of one keeps its symbol's name."""
    return np.where(lengths > 1, mix(symbols ^ (lengths.astype(np.uint64) * _RUN) ^ U64(2 * number + 1)), symbols)


def pair_names(left: np.ndarray, right: np.ndarray, number: int) -> np.ndarray:
    return mix((left * _PAIR) ^ right ^ U64(2 * number + 2))


@dataclass
class Level:
    """The symbols after a round: names, signatures, first words, and whether a text begins with them; and for
    each window the range of its interior symbols, empty if ``low >= high``."""

    names: np.ndarray
    signatures: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray


def next_level(of: Level, number: int) -> Level:
    """One round: runs, then pairs. ``of`` has a symbol or more."""
    begin = of.first.copy()
    begin[0] = True
    begin[1:] |= of.names[1:] != of.names[:-1]
    at = np.flatnonzero(begin)
    names = run_names(of.names[at], np.diff(np.append(at, len(begin))), number)
    first = of.first[at]
    # the run that holds the symbol at an edge is not interior
    group = np.cumsum(begin) - 1
    some = of.low < of.high
    low = np.where(some, group[np.minimum(of.low, len(group) - 1)] + 1, 0)
    high = np.where(some, group[np.maximum(of.high - 1, 0)], 0)

    left = (mix(names ^ U64(number)) & U64(1)).astype(bool)
    joined = np.flatnonzero(left[:-1] & ~left[1:] & ~first[1:])
    paired = names.copy()
    paired[joined] = pair_names(names[joined], names[joined + 1], number)
    keep = np.ones(len(names), bool)
    keep[joined + 1] = False
    # nor is a symbol at an edge that may be paired with one outside
    some = low < high
    low = low + np.where(some, ~left[np.minimum(low, len(left) - 1)], False)
    high = high - np.where(some, left[np.maximum(high - 1, 0)], False)
    some = low < high
    place = np.cumsum(keep) - 1
    low = np.where(some, place[np.minimum(low, len(place) - 1)], 0)
    high = np.where(some, place[np.maximum(high - 1, 0)] + 1, 0)

    begins = at[keep]
    ends = np.append(begins[1:], len(begin))
    before, after = np.zeros(len(begins), np.uint64), np.zeros(len(begins), np.uint64)
    before[1:] = of.signatures[begins[1:] - 1]
    after[:-1] = of.signatures[ends[:-1]]
    names = paired[keep]
    signatures = mix(mix(mix(before) + names) * _PAIR + after)
    return Level(names, signatures, of.starts[begins], first[keep], low, high)


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least value in each range ``low <= place < high``, the leftmost of equal ones. No range is empty."""
    width = high - low
    best, out, size = np.arange(len(values)), np.empty(len(low), np.int64), 1
    while True:
        # ``best``: the place of the least of ``size`` values from each place on; two of them cover a range of up to twice as many
        now = np.flatnonzero((width >= size) & (width < 2 * size))
        left, right = best[low[now]], best[high[now] - size]
        out[now] = np.where(values[left] <= values[right], left, right)
        if not len(width) or 2 * size > width.max():
            return out
        left, right = best[:-size], best[size:]
        best, size = np.where(values[left] <= values[right], left, right), 2 * size


def anchors(words: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: the number of its anchor (equal for successive windows with one anchor), the anchor's
    first word, and its key. A window without an interior symbol is its own anchor, with its content as key."""
    n = len(words) - window + 1
    own = np.arange(n)
    levels = [Level(words, words, np.arange(len(words)), first, own, own + window)]
    for depth in range(rounds):
        levels.append(next_level(levels[-1], depth))
    number, place, key = own.copy(), own.copy(), np.empty(n, np.uint64)
    left = own  # windows whose anchor is not found in a higher level
    for depth in range(rounds, 0, -1):
        level = levels[depth]
        some = left[level.low[left] < level.high[left]]
        best = least_in(level.signatures, level.low[some], level.high[some])
        least = level.signatures[best]
        found = least < _NONE
        some, best = some[found], best[found]
        number[some], place[some], key[some] = depth * len(words) + best, level.starts[best], least[found]
        rest = np.zeros(n, bool)
        rest[left] = True
        rest[some] = False
        left = np.flatnonzero(rest)
    if len(left):
        key[left] = window_hashes(words, window)[left]
    return number, place, key


def cut_segments(window: int, part_words: int = 1 << 22):
    """Cutter for ``repeats.segments`` over words."""

    def windows(words: np.ndarray, first_word: np.ndarray):
        first = np.zeros(len(words) + 1, bool)
        first[first_word] = True
        number, place, key = anchors(words, first[:-1], window)
        row = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))[: len(number)]
        usable = np.arange(len(number)) + window <= first_word[row + 1]
        starts, counts = repeats.runs_of(number, usable)
        contents = stretch_hashes(prefix_sums(words), starts, counts - 1 + window)
        begin = first_word[row[starts]]
        return row[starts], starts - begin, place[starts] - begin, counts, key[starts], contents

    def cut(data: np.ndarray, offsets: np.ndarray):
        begins, ends, first_word = word_bounds(data, offsets)
        words = word_hashes(data, begins, ends)
        if len(words) < window:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        if len(words) <= part_words:
            return windows(words, first_word)
        found = []  # one very long text, in parts that overlap by a window less one word
        for text in range(len(offsets) - 1):
            for at in range(int(first_word[text]), int(first_word[text + 1]) - window + 1, part_words):
                part = words[at : min(at + part_words + window - 1, int(first_word[text + 1]))]
                row, starts, anchors, *rest = windows(part, np.array([0, len(part)]))
                moved = at - int(first_word[text])
                found.append((row + text, starts + moved, anchors + moved, *rest))
        return tuple(np.concatenate(x) for x in zip(*found))

    return cut


def _word_stretches(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, stretches: list) -> list[np.ndarray]:
    begins, ends, first_word = word_bounds(data, offsets)
    sums, first = prefix_sums(word_hashes(data, begins, ends)), first_word[row]
    return [stretch_hashes(sums, first + starts, lengths) for starts, lengths in stretches]


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(did, tag, spans) for ``repeats.identified`` documents: the maximal runs of words to remove."""
    segments = pin(repeats.segments(docs, cut_segments(window)), "symbols")
    counts = segments.groupBy("key").agg(F.count("*").alias("times"))
    keys = pin(counts.where("times > 1").select("key"), "shared-symbols")
    shared = pin(segments.join(keys, "key", "left_semi"), "segments-shared")
    drop(segments, keys)
    return repeats.covered(shared, docs, _word_stretches, window, keep_first=True, grids=(1,))


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            words = text.as_buffer().to_pybytes().split()
            counts.append(len(words))
            if spans.is_valid:
                for span in reversed(spans.as_py()):
                    del words[span["start"] : span["stop"]]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("did"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["did", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per document; ``kept`` are the remaining words, joined by
    one space."""
    own = repeats.identified(docs, id_column, text)
    spans = repeated_spans(own, window)
    joined = own.join(spans.hint("shuffle_hash"), ["did", "tag"], "left").select("did", "text", "spans")
    cut = joined.mapInArrow(_cut_words, "did long, n_words long, n_removed long, kept string")
    number = F.when(F.col("did") != repeats.NULL_ID, F.col("did"))
    return cut.select(number.alias("doc_id"), "n_words", "n_removed", "kept")
