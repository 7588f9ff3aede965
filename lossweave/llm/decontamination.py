"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Words are lower-cased runs of letters and digits. One pass over the texts keeps, of every document that holds
an n-gram of a test item, the regions around those n-grams (as word hashes, no text); other documents end
there. The document frequency of each n-gram over the whole corpus then tells which are rare: an item's
seeds are its n-grams that are at most ``common`` times as frequent as its median one, so every item keeps seeds
even if a third of the corpus holds it, and those that edited copies share with plain ones stay. Regions and items that share a seed are aligned by Smith-Waterman over words; the
score is divided by that of a perfect copy, so an edited or paraphrased copy of an item is found as well.

Benchmarks of any size are worked through in blocks of at most ``block_words`` words; the block's n-grams are
the only thing that is sent to the tasks. Items of fewer words than an n-gram are too short to tell a copy by, and
are left out.

Defined results: null texts and items have no words and match nothing; rows that share an id are
reported as one document; null ids are kept; an empty table on either side gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.arrays import pieces, window_hashes
from lossweave.llm.tables import pin
from lossweave.llm.toxicity import tokens_of

MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
_REGION = "doc_id long, at long, words array<long>, grams array<long>"


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, _, whole, _, first = tokens_of(column)
    return whole, first


def item_words(benchmark: DataFrame, n: int, block_words: int) -> Iterator[dict[int, np.ndarray]]:
    """The items' word hashes, in blocks of at most ``block_words`` words (one longer item stays whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, first = _words_of(piece.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("item_id"), lists], names=["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = pin(items.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") >= n).distinct(), "items")
    block, size = {}, 0
    for row in words.orderBy("item_id").toLocalIterator():  # a block at a time on the driver
        if size and size + len(row.words) > block_words:
            yield block
            block, size = {}, 0
        block[len(block)] = (row.item_id, np.array(row.words, np.int64).view(np.uint64))
        size += len(row.words)
    if block:
        yield block


def _regions(wanted: np.ndarray, n: int, pad: int):
    """Task: per document the regions around the block's n-grams, whose sorted hashes are ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, first = _words_of(piece.column("text"))
                row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                hashes = window_hashes(words, n)
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                place = np.flatnonzero(wanted[at] == hashes)
                place = place[row_of[place] == row_of[place + n - 1]]
                value, row = hashes[place], row_of[place]
                cut = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(place) > 2 * pad))) if len(place) else []
                ends = np.append(cut[1:], len(place)).astype(np.int64) if len(place) else []
                out = [[], [], [], []]
                numbers = piece.column("doc_id")
                for a, b in zip(cut, ends):
                    lo, hi = max(place[a] - pad, first[row[a]]), min(place[b - 1] + pad, first[row[a] + 1])
                    out[0].append(numbers[int(row[a])].as_py())
                    out[1].append(int(lo - first[row[a]]))
                    out[2].append(words[lo:hi].view(np.int64))
                    out[3].append(np.unique(value[a:b]).view(np.int64))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "at", "words", "grams"])

    return run


def align(item: np.ndarray, regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of an item in each region, and where it ends. A row of the matrix is filled
    at once: gaps along the row are a running maximum."""
    width = max(map(len, regions))
    table = np.zeros((len(regions), width), np.uint64)
    inside = np.zeros((len(regions), width), bool)
    for k, region in enumerate(regions):
        table[k, : len(region)] = region
        inside[k, : len(region)] = True
    slope = -GAP * np.arange(width + 1)
    before = np.zeros((len(regions), width + 1))
    best, end = np.zeros(len(regions)), np.zeros(len(regions), np.int64)
    for word in item:
        step = np.where((table == word) & inside, MATCH, MISMATCH)
        now = np.zeros_like(before)
        now[:, 1:] = np.maximum(np.maximum(before[:, :-1] + step, before[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        peak = now.argmax(axis=1)
        value = now[np.arange(len(regions)), peak]
        better = value > best
        best[better], end[better] = value[better], peak[better]
        before = now
    return best, end


def _aligned(block: dict, seeds: dict[int, list[int]], least: float, batch_cells: int = 2_000_000):
    """Task over regions: aligns each with the items whose seeds it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, at = batch.column("doc_id").to_pylist(), batch.column("at").to_pylist()
            wanted = defaultdict(list)
            for k, grams in enumerate(batch.column("grams")):
                for key in {i for g in grams.values.to_numpy().tolist() for i in seeds.get(g, ())}:
                    wanted[key].append(k)
            words = batch.column("words")
            region = lambda k: words[k].values.to_numpy().view(np.uint64)
            rows = []
            for key, members in wanted.items():
                item_id, item = block[key]
                members.sort(key=lambda k: len(words[k]))
                while members:
                    count = max(1, batch_cells // max(1, len(words[members[min(len(members), 256) - 1]])))
                    part, members = members[: min(count, 256)], members[min(count, 256) :]
                    found = [region(k) for k in part]
                    best, end = align(item, found)
                    good = np.flatnonzero(best >= least * MATCH * len(item))
                    if len(good):
                        _, back = align(item[::-1], [found[g][: end[g]][::-1] for g in good])
                        for g, b in zip(good, back):
                            start, stop = at[part[g]] + int(end[g] - b), at[part[g]] + int(end[g])
                            rows.append((numbers[part[g]], item_id, float(best[g]) / (MATCH * len(item)), start, stop))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "score", "start_word", "end_word"]
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5, block_words: int = 500_000, common: float = 8) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best copy of an item in each document where it
    reaches ``least`` of a perfect copy's alignment score; words are counted from 0, the end excluded."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body)
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    found = spark.createDataFrame([], schema)
    for block in item_words(benchmark, n, block_words):
        of_item = {key: window_hashes(words, n) for key, (_, words) in block.items()}
        wanted = np.unique(np.concatenate(list(of_item.values())))
        pad = max(len(words) for _, words in block.values())
        regions = pin(source.mapInArrow(_regions(wanted, n, pad), _REGION), "regions")
        # as many rows as the block has n-grams, at most
        counted = regions.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()
        frequency = {r.gram: r["count"] for r in counted}
        seeds = defaultdict(list)
        for key, grams in of_item.items():
            mine = np.unique(grams).view(np.int64).tolist()
            most = common * max(1.0, float(np.median([frequency.get(g, 0) for g in mine])))
            for g in mine:
                if frequency.get(g, 0) <= most:
                    seeds[g].append(key)
        found = found.unionByName(regions.mapInArrow(_aligned(block, dict(seeds), least), schema))
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.back")).alias("start_word"), "best.end_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents (all columns) that hold no copy of a test item."""
    leaks = contaminated(docs, benchmark, **settings).select("doc_id").distinct().hint("shuffle_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    clean = rows.join(leaks, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")), "left_anti")
    return clean.select("row.*")
