"""Periodic runs of words by suffix trees and Lyndon roots.

A run is a stretch of words with a smallest period ``q`` that is at least ``exponent`` periods long and that no
neighbouring word extends. Every run contains, in the order of its words or in the reverse order, a Lyndon
root: a stretch that is the longest Lyndon word at its start, which reaches to the next smaller (or next
larger) suffix. So each position gives two candidates, whose length is the run's period. Ukkonen's trees of
the words and of their reversal, with an Euler tour and range minima over its string depths, tell in constant
time how far a candidate's period goes to the right and to the left. What remains long enough is a run; the
trees give the order of the suffixes, too.

Trees are built only where a run can be. In a run of period ``q`` every word but the first ``q`` repeats one
at most ``q`` words before it. So for caps 1, 2, 4, ... the stretches of words that repeat one at most a cap
before, if long enough for a period above half the cap, hold all runs of such periods but for their first
words. These stretches, widened by the cap and a word on either side, are joined where they meet; prose has
next to none of them. Equal words have equal hashes, so this test leaves out nothing; the trees compare the
words themselves.

Defined results: null text has no words; rows are independent of each other, whatever their ids (null and
repeated ones included); an empty table gives an empty result; further columns are ignored. A task holds one
text and its longest periodic stretch at a time (about a kilobyte a word of that stretch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lossweave.llm.arrays import BLOCK, mix, pieces, text_bytes, word_bounds, word_hashes

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
_BLOCK = 16


class SuffixTree:
    """Ukkonen's suffix tree of symbols from 1 on; ``lce`` compares suffixes, ``rank`` sorts them."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self._build([*symbols, 0])
        self._tour()

    def _build(self, s: list[int]) -> None:
        n, width = len(s), max(s) + 1
        start, stop, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            unlinked = 0
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i), stop.append(n), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    begin = start[child]
                    size = min(stop[child], i + 1) - begin
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    edges[key] = middle
                    start.append(begin), stop.append(begin + length), link.append(0)
                    edges[middle * width + c] = len(start)
                    start.append(i), stop.append(n), link.append(0)
                    start[child] = begin + length
                    edges[middle * width + s[begin + length]] = child
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                else:
                    node = link[node]
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        child = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.children = child.tolist()
        bounds = np.searchsorted(keys[order], np.arange(len(start) + 1) * width)
        self.first, self.leaf = bounds.tolist(), (np.diff(bounds) == 0).tolist()
        self.size = (np.array(stop) - np.array(start)).tolist()
        self.total = n

    def _tour(self) -> None:
        """Euler tour in the order of the symbols: string depths on the way, and where each suffix's leaf stands."""
        first, leaf, size, children = self.first, self.leaf, self.size, self.children
        depths, place, order = [0], [0] * self.total, []
        stack, depth = [(0, first[0])], [0]
        while stack:
            node, at = stack.pop()
            if at == first[node + 1]:
                depth.pop()
                if depth:
                    depths.append(depth[-1])
                continue
            stack.append((node, at + 1))
            child = children[at]
            below = depth[-1] + size[child]
            depths.append(below)
            if leaf[child]:
                suffix = self.total - below
                place[suffix] = len(depths) - 1
                order.append(suffix)
                depths.append(depth[-1])
            else:
                stack.append((child, first[child]))
                depth.append(below)
        self.place = np.array(place, np.int64)
        self.rank = np.empty(self.total, np.int64)
        self.rank[order] = np.arange(self.total)
        # minima inside blocks from both sides, and over runs of blocks
        self.depths = np.array(depths, np.int32)
        full = -(-len(depths) // _BLOCK) * _BLOCK
        blocks = np.full(full, np.iinfo(np.int32).max, np.int32)
        blocks[: len(depths)] = self.depths
        blocks = blocks.reshape(-1, _BLOCK)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        step = 1
        while 2 * step <= len(blocks):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes ``a`` and ``b`` (different ones; ``n`` is the empty suffix)."""
        lo, hi = self.place[a], self.place[b]
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        left, right = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi])
        near = np.flatnonzero(left == right)
        if len(near):  # both in one block
            out[near] = self.depths[lo[near]]
            for k in range(1, _BLOCK):
                inside = near[lo[near] + k <= hi[near]]
                out[inside] = np.minimum(out[inside], self.depths[lo[inside] + k])
        far = np.flatnonzero(right - left > 1)
        if len(far):
            a, width = left[far] + 1, right[far] - left[far] - 1
            level = np.frexp(width.astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                some = level == k
                x, w = a[some], width[some]
                least = np.minimum(self.levels[k][x], self.levels[k][x + w - (1 << k)])
                out[far[some]] = np.minimum(out[far[some]], least)
        return out.astype(np.int64)


def _next_smaller(rank: list[int]) -> list[int]:
    """For each position but the last the next one with a smaller value (the last value is below all)."""
    out, stack = [0] * (len(rank) - 1), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    for i in stack[:-1]:
        out[i] = len(rank) - 1
    return out


def runs_of(words: list, least_length: int = 6, exponent: int = 4) -> np.ndarray:
    """(start, length, period) of all runs, sorted; ``exponent`` is 2 or more."""
    number: dict = {}
    symbols = [number.setdefault(w, len(number) + 1) for w in words]
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = ahead.rank  # the empty suffix comes first
    larger = n - rank
    larger[n] = -1
    i = np.tile(np.arange(n), 2)
    j = np.array(_next_smaller(rank.tolist()) + _next_smaller(larger.tolist()), np.int64)
    period = j - i
    fits = exponent * period <= n
    fits[n:] &= j[n:] < n  # runs that end with the text have their roots in the first order
    i, j, period = i[fits], j[fits], period[fits]
    start = i - back.lce(n - i, n - j)
    length = j + ahead.lce(i, j) - start
    good = (length >= exponent * period) & (length >= least_length)
    return np.unique(np.column_stack([start, length, period])[good], axis=0)


def _periodic_stretches(gap: np.ndarray, first: np.ndarray, least_length: int, exponent: int) -> np.ndarray:
    """Disjoint stretches (start, stop) that hold all runs and their neighbours; ``gap`` is the distance to the
    word's previous occurrence in its text, ``first`` holds the first word of each text."""
    found, cap = [], 1
    most = int(np.diff(first).max(initial=0))
    while True:
        least = max((exponent - 1) * (cap // 2 + 1), least_length - cap)
        if least > most:
            break
        near = np.concatenate([[False], gap <= cap, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        start, stop = edge[::2], edge[1::2]
        long_ = stop - start >= least
        start, stop = start[long_], stop[long_]
        text = np.searchsorted(first, start, "right") - 1
        found.append(np.column_stack([np.maximum(start - cap - 1, first[text]), np.minimum(stop + 1, first[text + 1])]))
        cap *= 2
    spans = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    text = np.searchsorted(first, spans[:, 0], "right")
    new = np.flatnonzero(np.append(True, (spans[1:, 0] >= reach[:-1]) | (text[1:] != text[:-1])))
    return np.column_stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], new)])


def _runs_by_text(column: pa.Array, least_length: int, exponent: int) -> dict[int, np.ndarray]:
    """Runs of the texts that have some, by row."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = word_hashes(data, starts, ends) ^ mix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    gap = np.full(len(key), np.iinfo(np.int64).max)
    again = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]]))
    gap[order[again + 1]] = order[again + 1] - order[again]
    found: dict[int, list[np.ndarray]] = {}
    raw = data.tobytes() if len(data) else b""
    for a, b in _periodic_stretches(gap, first, least_length, exponent).tolist():
        words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
        runs = runs_of(words, least_length, exponent)
        if len(runs):
            runs[:, 0] += a - first[row[a]]
            found.setdefault(int(row[a]), []).append(runs)
    return {k: np.concatenate(v) for k, v in found.items()}


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def collapse_runs(docs: DataFrame, least_length: int = 6, exponent: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, kept): the runs of every text by start and period, and its words without the
    repeats inside runs, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", BLOCK):
                found = _runs_by_text(piece.column("text"), least_length, exponent)
                counts, kept, runs = [], [], []
                for k, body in enumerate(piece.column("text")):
                    words = body.as_buffer().to_pybytes().split()
                    counts.append(len(words))
                    own = found.get(k)
                    if own is not None:
                        own = own[np.lexsort((own[:, 2], own[:, 0]))]
                        words = _collapsed(words, own)
                    kept.append(b" ".join(words))
                    runs.append([] if own is None else [dict(zip(("start", "length", "period"), r)) for r in own.tolist()])
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, _RUN), texts],
                    names=["doc_id", "n_words", "runs", "kept"],
                )

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), body).mapInArrow(run, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the crc32 of its id, gets a periodic end made of its own words.
    Documents without an id stay as they are."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10).cast("long")
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    chosen = chosen.select("doc_id", "text", "words", a.alias("a"), p.alias("p"))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    tail = F.transform(
        F.sequence(F.lit(0).cast("long"), F.size("words") - F.col("a") - 1), lambda k: F.get("words", (F.col("a") + k % F.col("p")).cast("int"))
    )
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones that with the least start, then period."""
    better = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    before = lambda x, y: F.when(better(x, y) != 0, F.sign(better(y, x)))
    ordered = F.array_sort(
        runs,
        lambda x, y: before(x, y)
        .when(x["start"] != y["start"], F.sign(x["start"] - y["start"]))
        .otherwise(F.sign(x["period"] - y["period"]))
        .cast("int"),
    )
    return F.get(ordered, F.lit(0))
