"""Exact repeated windows from content-defined segments.

Every window of a fixed number of units (bytes or words) picks an anchor from its own content; the windows
of a text that follow each other with the same anchor are a *segment*. Equal windows have equal anchors, so
only segments with a shared anchor key can hold repeated windows. Segments whose whole content is shared are
settled as such. Of the others, one representative per content is opened: its windows fall into cells of some
positions on a grid that is counted from the anchor. All windows of a cell contain the cell's core, so cells
with a core of their own are done; cells that are shared whole are settled; of the rest one representative
per content is opened again, down to single windows. No pair of occurrences is ever formed: each level
is counting by hash with partial sums before the shuffle, so a hot passage costs one row per task.

A row of any level is (key, ctx, did, span, copies): the key that equal windows must share, the hash of the
whole content, the document id (null as the least long), and start, text tag, grid phase and number of
windows packed into a long. The tag tells rows apart that share an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lossweave.llm.arrays import mix, pieces, text_bytes
from lossweave.llm.tables import drop, pin

GRID = 32  # windows in a cell; the phase has five bits
MOST_WINDOWS = 1023  # longer segments are cut; the parts share their key
NULL_ID = -(2**63)
LEVEL = "key long, ctx long, did long, span long, copies int"
_LEVEL = pa.schema([*((c, pa.int64()) for c in ("key", "ctx", "did", "span")), ("copies", pa.int32())])


def identified(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(did, tag, text): null ids become the least long, null texts the empty text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NULL_ID)).alias("did"), tag_of(body).alias("tag"), body.alias("text")
    )


def tag_of(body: Column) -> Column:
    return F.xxhash64(body).bitwiseAND(F.lit((1 << 16) - 1))


def _bits(column: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << width) - 1))


def start_of(column: str = "span") -> Column:
    return _bits(column, 32, 31)


def tag_in() -> Column:
    return _bits("span", 16, 16)


def length_of() -> Column:
    return _bits("span", 0, 10)


def pack_rows(keys, contents, dids, tags, starts, phases, counts, copies) -> pa.RecordBatch:
    span = (starts.astype(np.int64) << 32) | (tags << 16) | (phases.astype(np.int64) << 11) | counts
    columns = (keys.view(np.int64), contents.view(np.int64), dids, span, copies.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_LEVEL)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: which entry each of sum(c) items belongs to, and its number inside the entry."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs_of(anchor: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal anchors among usable windows, cut at MOST_WINDOWS."""
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~usable[:-1]
    starts = np.flatnonzero(change & usable)
    stops = np.flatnonzero(np.append(change[1:] | ~usable[1:], True)[: len(anchor)] & usable) + 1
    counts = stops - starts
    if len(counts) and counts.max() > MOST_WINDOWS:
        which, nth = spread(-(-counts // MOST_WINDOWS))
        starts, counts = starts[which] + nth * MOST_WINDOWS, np.minimum(counts[which] - nth * MOST_WINDOWS, MOST_WINDOWS)
    return starts, counts


def segments(docs: DataFrame, cut: Callable) -> DataFrame:
    """Segment rows of ``identified`` documents. ``cut(data, offsets)`` works on the bytes of many texts and
    gives per segment: row, start in its text, anchor's place in its text, number of windows, key, content
    hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                row, starts, anchors, counts, keys, contents = cut(*text_bytes(piece.column("text")))
                dids, tags = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tag"))
                yield pack_rows(keys, contents, dids[row], tags[row], starts, anchors % GRID, counts, np.ones(len(row)))

    return docs.mapInArrow(run, LEVEL)


def _cells(hashes_of: Callable, window: int, grid: int):
    """Task over (did, tag, text, opened): the rows of the next level, cells of ``grid`` positions."""

    def cells(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(piece.column("text"))
        dids, tags = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tag"))
        opened = piece.column("opened")
        keys, spans, copies = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in opened.flatten().flatten())
        begin, phase, count = spans >> 32, (spans >> 11) & (GRID - 1), spans & MOST_WINDOWS
        first = (begin - phase) // grid
        which, nth = spread((begin + count - 1 - phase) // grid - first + 1)
        left = (first[which] + nth) * grid + phase[which]  # of the whole cell, even if it is cut at an edge
        lo, hi = np.maximum(left, begin[which]), np.minimum(left + grid, (begin + count)[which])
        text = np.repeat(np.arange(piece.num_rows), opened.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[which]
        ends = hi - 1 + window - lo
        core, *rest = hashes_of(data, offsets, text, [(left + grid - 1, np.full(len(left), window - grid + 1)), *([] if grid == 1 else [(lo, ends)])])
        whole = rest[0] if rest else core
        parent = mix(keys[which].view(np.uint64))
        contents = mix(parent ^ whole) if grid > 1 else parent
        return pack_rows(
            mix(parent + core) if grid > 1 else core, contents, dids[text], tags[text], lo,
            np.zeros(len(which), np.int64), hi - lo, copies[which],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):  # many texts at a time
                yield cells(piece)

    return run


def _merged(window: int):
    """Task: joins the covered ranges of each text into maximal runs of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            spans = []
            for cell in batch.column("found"):
                packed = np.sort(cell.values.to_numpy(zero_copy_only=False).astype(np.int64))
                starts = packed >> 32
                reach = np.maximum.accumulate(starts + (packed & MOST_WINDOWS) - 1 + window)
                first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
                last = np.append(first[1:], len(starts)) - 1
                spans.append([{"start": a, "stop": b} for a, b in zip(starts[first].tolist(), reach[last].tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("tag"), pa.array(spans, kind)], names=["did", "tag", "spans"]
            )

    return run


def covered(shared: DataFrame, docs: DataFrame, hashes_of: Callable, window: int, keep_first: bool, grids: tuple[int, ...]) -> DataFrame:
    """(did, tag, spans): the maximal runs of units covered by repeated windows.

    ``shared``, a written table, holds at least all segments whose key occurs twice; ``hashes_of(data, offsets, row, stretches)`` hashes
    stretches of units, lists of (starts, lengths), of the texts with these bytes; ``row`` is the text of each stretch; ``grids`` are the cell sizes of the levels, the last one 1. With
    ``keep_first`` a window counts as repeated if its content also starts earlier (smaller id, or earlier in
    the same text); otherwise if it also starts anywhere else."""
    rows, texts, found = shared, docs, None
    for grid in (*grids, None):
        classes = rows.groupBy("key", "ctx").agg(F.sum("copies").alias("total"), F.min(F.struct("did", "span")).alias("rep"))
        classes = pin(classes, "contents")
        several = classes.where("total > 1")
        if keep_first:
            first = several.select("key", "ctx", F.col("rep.did").alias("first_did"), start_of("rep.span").alias("first_start"))
            later = (F.col("did") > F.col("first_did")) | ((F.col("did") == F.col("first_did")) & (start_of() > F.col("first_start")))
            settled = rows.join(first, ["key", "ctx"]).where(later)
        else:
            settled = rows.join(several, ["key", "ctx"], "left_semi")
        settled = pin(settled.select("did", "span"), "settled")
        found = settled if found is None else found.unionByName(settled)
        if grid is None:
            drop(rows, classes)
            break
        variants = pin(classes.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1").select("key"), "variants")
        one = F.struct("key", "rep.span", F.least("total", F.lit(2)).cast("int").alias("copies"))
        open_ = classes.join(variants, "key", "left_semi").select(F.col("rep.did").alias("did"), F.col("rep.span").alias("span"), one.alias("one"))
        opened = open_.groupBy("did", tag_in().alias("tag")).agg(F.collect_list("one").alias("opened"))
        before = texts
        of_texts = texts.select("did", "tag", "text").join(opened.hint("shuffle_hash"), ["did", "tag"])
        if grid != grids[-1]:
            of_texts = texts = pin(of_texts, "texts-opened")
        cells = pin(of_texts.mapInArrow(_cells(hashes_of, window, grid), LEVEL), "cells")
        drop(rows, classes, variants, *([before] if before is not docs else []))
        rows = cells
    ranges = found.groupBy("did", tag_in().alias("tag")).agg(F.collect_list("span").alias("found"))
    return ranges.mapInArrow(_merged(window), "did long, tag long, spans array<struct<start: long, stop: long>>")
