"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

The arrays are sparse: of the suffixes of a text only those at content-defined anchors enter. A 400-byte
string holds 337 seeds of 64 bytes; the seed with the least hash is its anchor, so equal strings share their
anchor, wherever they stand. An array is dealt out by ranges of the anchor's seed (a hash of the suffix's first
64 bytes) and the surrounding segment, and inside a task its entries lie in that order, so that suffixes with a
common prefix of at least 64 bytes are neighbours.

New batches get an array of their own, which is merge-scanned (a sort-merge join on the suffix order) against
every level of the index to find seeds that both hold. Then levels of equal rank merge, like the carries of a
binary counter: after n batches there are at most log2(n) + 1 levels, and each entry was merged as often at
most. At the end the shared suffixes are extended both ways over whole texts (``repeats.covered``): a byte
goes if it is covered by a 400-byte string that also starts anywhere else.

Defined results: null text is empty text; texts under 400 bytes stay; rows that share an id are told apart by
their texts; repeated rows repeat each other; an empty table gives an empty result. Null ids are kept.
Further columns are kept unless their names clash with the result's, whose columns then win.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lossweave.llm import repeats
from lossweave.llm.arrays import _BYTES, BLOCK, U64, byte_window_hashes, prefix_sums, sliding_minimum, stretch_hashes
from lossweave.llm.tables import drop, pin

SEED = 64
_PLACE = U64((1 << 24) - 1)


def cut_segments(match: int, seed: int = SEED):
    """Cutter for ``repeats.segments`` over bytes."""
    seeds_in = match - seed + 1

    def windows(data: np.ndarray, offsets: np.ndarray):
        seeds = byte_window_hashes(data, seed)
        ranked = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64)
        least = sliding_minimum(ranked, seeds_in)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        usable = np.arange(len(least)) + match <= offsets[row + 1]
        place = (least & _PLACE).astype(np.int64)
        # windows of two texts never meet: the last ones of a text are not usable
        starts, counts = repeats.runs_of(least, usable)
        contents = stretch_hashes(prefix_sums(_BYTES[data]), starts, counts - 1 + match)
        begin, anchor = offsets[row[starts]], place[starts]
        return row[starts], starts - begin, anchor - begin, counts, seeds[anchor], contents

    def cut(data: np.ndarray, offsets: np.ndarray):
        if len(offsets) > 2 or len(data) <= 4 * BLOCK:
            return windows(data, offsets) if len(data) >= match else _none()
        found = []  # one very long text, in parts that overlap by a window less one byte
        for at in range(0, len(data) - match + 1, 4 * BLOCK):
            part = data[at : at + 4 * BLOCK + match - 1]
            row, starts, anchors, *rest = windows(part, np.array([0, len(part)]))
            found.append((row, starts + at, anchors + at, *rest))
        return tuple(np.concatenate(x) for x in zip(*found))

    return cut


def _none():
    none = np.zeros(0, np.int64)
    return none, none, none, none, none.view(np.uint64), none.view(np.uint64)


def _byte_stretches(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, stretches: list) -> list[np.ndarray]:
    sums = prefix_sums(_BYTES[data])
    return [stretch_hashes(sums, offsets[row] + starts, lengths) for starts, lengths in stretches]


class SuffixIndex:
    """The index family: ``add`` takes the segments of a new batch, ``shared_keys`` returns all seeds that
    occur twice in what was added."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.hits: list[DataFrame] = []

    @staticmethod
    def _array(entries: DataFrame, label: str) -> DataFrame:
        summed = entries.groupBy("key", "ctx").agg(F.sum("copies").alias("copies"))
        tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # by ranges of the order: a seed with very many surroundings is split over neighbouring tasks
        return pin(summed.repartitionByRange(tasks, "key", "ctx").sortWithinPartitions("key", "ctx"), label)

    def add(self, segments: DataFrame) -> None:
        own = self._array(segments.select("key", "ctx", "copies"), "suffixes")
        inside = own.groupBy("key").agg(F.sum("copies").alias("times"))
        found = [inside.where("times > 1").select("key")]
        keys = own.select("key").distinct()
        # both sides hold a seed once: a semi join would be moved below the distinct, to all surroundings of a seed
        found += [keys.join(level.select("key").distinct().hint("merge"), "key") for _, level in self.levels]
        hits = found[0]
        for more in found[1:]:
            hits = hits.unionByName(more)
        self.hits.append(pin(hits.distinct(), "shared-seeds"))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            last = self.levels.pop()[1]
            merged = self._array(own.unionByName(last), "suffixes")
            drop(own, last)
            own, rank = merged, rank + 1
        self.levels.append((rank, own))

    def close(self) -> None:
        """Deletes the arrays; the shared seeds stay."""
        drop(*[level for _, level in self.levels])
        self.levels = []

    def shared_keys(self) -> DataFrame:
        keys = self.hits[0]
        for more in self.hits[1:]:
            keys = keys.unionByName(more)
        return keys.distinct()


def repeated_spans(docs: DataFrame, match: int = 400, batches: int = 4, keep_first: bool = False) -> DataFrame:
    """(did, tag, spans) for ``repeats.identified`` documents: the maximal runs of bytes to remove."""
    segments = pin(repeats.segments(docs, cut_segments(match)), "segments")
    index = SuffixIndex()
    for batch in range(batches):
        of_doc = F.pmod(F.xxhash64("did", repeats.tag_in()), F.lit(batches))
        index.add(segments.where(of_doc == batch))
    index.close()
    # a written side, not an aggregate: adaptive execution splits a skewed seed only next to plain shuffles
    keys = pin(index.shared_keys(), "shared-seeds")
    shared = pin(segments.join(keys, "key", "left_semi"), "segments-shared")
    drop(segments, keys, *index.hits)
    return repeats.covered(shared, docs, _byte_stretches, match, keep_first=keep_first, grids=(repeats.GRID, 1))


def _inside_character(data: Column, at: Column) -> Column:
    """Whether a UTF-8 character continues at a byte (from 0)."""
    return F.substring(data, (at + 1).cast("int"), F.lit(1)).between(F.lit(bytearray([0x80])), F.lit(bytearray([0xBF])))


def _whole_characters(data: Column, span: Column) -> Column:
    """A span, widened to the bounds of the characters that it cuts (of four bytes at most)."""

    def bound(at: Column, step: int) -> Column:
        out = F.when(~_inside_character(data, at), at)
        for k in (1, 2):
            out = out.when(~_inside_character(data, at + k * step), at + k * step)
        return out.otherwise(at + 3 * step)

    return F.struct(bound(span["start"], -1).alias("start"), bound(span["stop"], 1).alias("stop"))


def remove_repeats(
    docs: DataFrame, match: int = 400, batches: int = 4, id_column: str = "doc_id", text: str = "text",
    keep_first: bool = False, whole_characters: bool = False,
) -> DataFrame:
    """All columns of ``docs`` with ``spans`` (removed runs of bytes, start and stop) and ``kept`` (the
    remaining bytes). With ``keep_first`` a string goes only where it also starts earlier (in a document with a
    smaller id, or earlier in the same one). With ``whole_characters`` spans take all of a character that they
    touch, so that ``kept`` is UTF-8."""
    spans = repeated_spans(repeats.identified(docs, id_column, text), match, batches, keep_first)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(repeats.NULL_ID))
    own = [c for c in docs.columns if c not in ("spans", "kept")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key.alias("did"), repeats.tag_of(body).alias("tag"), F.encode(body, "UTF-8").alias("data"))
    joined = rows.join(spans.hint("shuffle_hash"), ["did", "tag"], "left")
    data = F.col("data")
    removed = F.transform("spans", lambda s: _whole_characters(data, s)) if whole_characters else F.col("spans")
    part = lambda start, stop: F.substring(data, (start + 1).cast("int"), (stop - start).cast("int"))
    kept = F.aggregate(
        removed,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept")),
        lambda state, s: F.struct(s["stop"].alias("at"), F.concat(state["kept"], part(state["at"], s["start"])).alias("kept")),
        lambda state: F.concat(state["kept"], part(state["at"], F.octet_length(data).cast("long"))),
    )
    kept = F.when(F.col("spans").isNull(), data).otherwise(kept)
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return joined.select("row.*", F.coalesce(removed, none).alias("spans"), kept.alias("kept"))
