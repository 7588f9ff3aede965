"""Compressed vector cells: product-quantised residuals, searched by look-up and scored exactly at the end.

A quantizer has the centres of cells and, for each of ``parts`` stretches of a vector, a book of codes for what
is left after its cell's centre is taken off. It is fitted on a bounded sample of the claims (``sample`` unit
vectors, a parameter); every claim is indexed. The stored index holds a byte per stretch in place of the
vector, in folders by cell, beside the vector itself. A search reads the codes of the cells nearest to its
queries, looks the stretches up in the books, and keeps ``candidates`` claims per query by that approximate
distance. Only their vectors are read, and the result's distances are exact.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossweave.functions.vectors import DISTANCE_DECIMALS, Nearest, as_matrix, chunks, stored_block, unit_rows, unit_vector
from lossweave.operators.keyword import top_per_query
from lossweave.operators.semantic import MERGE_GROUPS, QUERY_BLOCK, _store_blocks
from lossweave.runtime import write_once

# The kernels travel with the tasks that use them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 65_536
_AT_ONCE = 2_000_000


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    out = np.empty(len(rows), np.int64)
    step = max(1, _AT_ONCE // len(centres))
    for at in range(0, len(rows), step):
        out[at : at + step] = np.argmin(half - rows[at : at + step] @ centres.T, axis=1)
    return out


def _means(rows: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """k-means centres; a centre that loses all its rows moves to the row furthest from its own centre."""
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = rows[draw.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        some = count > 0
        moved = centres.copy()
        moved[some] = sums[some] / count[some, None]
        if not some.all():
            gap = ((rows - centres[near]) ** 2).sum(axis=1)
            moved[~some] = rows[np.argsort(-gap, kind="stable")[: int((~some).sum())]]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass(frozen=True)
class Quantizer:
    centres: np.ndarray  # cells x width
    books: tuple[np.ndarray, ...]  # per stretch: codes x its width
    cuts: tuple[int, ...]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows, self.centres)

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        left = rows - self.centres[cells]
        return np.column_stack([_nearest(left[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]).astype(np.uint8)

    def look_up(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """The vectors that codes of a cell stand for."""
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1) + self.centres[cell]

    def probes(self, rows: np.ndarray, n: int) -> np.ndarray:
        gap = (self.centres**2).sum(axis=1) / 2 - rows @ self.centres.T
        return np.argsort(gap, axis=1, kind="stable")[:, :n]


def fit_quantizer(claims: DataFrame, cells: int = 64, parts: int = 16, codes: int = 256, sample: int = SAMPLE, seed: int = 42) -> Quantizer:
    """A quantizer from at most about ``sample`` claims with a vector, of which the driver holds that many."""
    vectors = claims.select("embedding").where("embedding is not null")
    total = vectors.count()
    if not total:
        raise ValueError("A quantizer needs claims with a vector; there are none.")
    some = vectors.sample(fraction=min(1.0, sample / total), seed=seed).limit(2 * sample) if total > sample else vectors
    rows = unit_rows(as_matrix(some.toArrow().column(0).combine_chunks()))
    centres = _means(rows, min(cells, len(rows)), seed)
    left = rows - centres[_nearest(rows, centres)]
    cuts = tuple(np.linspace(0, rows.shape[1], min(parts, rows.shape[1]) + 1).astype(int).tolist())
    books = tuple(_means(left[:, a:b], min(codes, 256, len(rows)), seed + k + 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return Quantizer(centres, books, cuts)


def write_cells(claims: DataFrame, quantizer: Quantizer, path: str) -> None:
    """Write the index of all claims with a vector below ``path``: a folder per cell with claim_id, code, embedding."""

    def encode(batches):
        for chunk in chunks(batches):
            chunk = chunk.combine_chunks()
            rows = unit_rows(as_matrix(chunk.column(1).chunk(0)))
            cells = quantizer.cells(rows)
            codes = quantizer.codes(rows, cells)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0).chunk(0), pa.array([c.tobytes() for c in codes], pa.binary()), chunk.column(1).chunk(0), pa.array(cells.astype(np.int32))],
                names=["claim_id", "code", "embedding", "cell"],
            )

    source = claims.select("claim_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    coded = source.mapInArrow(encode, "claim_id string, code binary, embedding array<double>, cell int")
    # ranges of (cell, id): a cell that holds very many claims is spread over files
    coded.repartitionByRange("cell", "claim_id").write.mode("overwrite").partitionBy("cell").parquet(path)


@dataclass(frozen=True)
class CellIndex:
    spark: SparkSession
    path: str
    quantizer: Quantizer

    def table(self) -> DataFrame:
        return self.spark.read.schema("claim_id string, code binary, embedding array<double>, cell int").parquet(self.path)

    def sizes(self) -> DataFrame:
        return self.table().groupBy("cell").agg(F.count("*").alias("size"))


def with_probes(queries: DataFrame, quantizer: Quantizer, n_probes: int) -> DataFrame:
    """(query_id, embedding, cells): the cells whose centres are nearest to each query."""

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                cells = quantizer.probes(unit_rows(as_matrix(batch.column(1))), n_probes).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["query_id", "embedding", "cells"])

    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.where("embedding is not null").mapInArrow(probe, "query_id string, embedding array<double>, cells array<int>")


def _looked_up(quantizer: Quantizer, path: str, slots: int, n: int):
    """Task over (claim_id, cell, code): the n nearest claims per query by what their codes stand for."""

    def search(batches):
        for chunk in chunks(batches, 256 << 20):
            chunk = chunk.sort_by("claim_id").combine_chunks()
            ids, cells = chunk.column(0).chunk(0), chunk.column(1).to_numpy()
            codes = np.frombuffer(b"".join(chunk.column(2).to_pylist()), np.uint8).reshape(len(cells), -1)
            members = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)}
            for slot in range(slots):
                block = stored_block(path, slot)
                if block is None:
                    continue
                table, queries = block
                lists = table.column("cells").chunk(0)
                asker = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                wanted = lists.flatten().to_numpy(zero_copy_only=False)
                best = Nearest(len(queries), n)
                for cell, rows in members.items():
                    asking = asker[wanted == cell]
                    step = max(1, _AT_ONCE // max(1, len(asking)))
                    for at in range(0, len(rows) if len(asking) else 0, step):
                        part = rows[at : at + step]
                        near = quantizer.look_up(codes[part], cell)
                        best.add(part, asking, (near**2).sum(axis=1)[:, None] / 2 - near @ queries[asking].T)
                query, distance, row = best.best()
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).chunk(0).take(pa.array(query)), ids.take(pa.array(row)), pa.array(cells[row].astype(np.int32)), pa.array(distance)],
                    names=["query_id", "claim_id", "cell", "approximate"],
                )

    return search


def _cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(unit_vector(a), unit_vector(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.round(1.0 - dot, DISTANCE_DECIMALS) + 0.0


def cell_candidates(
    index: CellIndex, queries: DataFrame, n: int = 10, n_probes: int = 8, candidates: int = 100, block: int = QUERY_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """The n nearest claims per query among the candidates, (query_id, claim_id, distance), and one row with
    ``scored_fraction``, the share of all (query, claim) pairs whose codes were looked at."""
    asked = write_once(with_probes(queries, index.quantizer, n_probes), "probes")
    path, slots = _store_blocks(asked, block)
    wanted = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # as many as cells, at most
    coded = index.table().where(F.col("cell").isin(wanted)).select("claim_id", "cell", "code")
    found = coded.mapInArrow(_looked_up(index.quantizer, path, slots, candidates), "query_id string, claim_id string, cell int, approximate double")
    order = (F.col("approximate"), F.col("claim_id"))
    grouped = found.withColumn("_group", F.pmod(F.xxhash64("claim_id"), F.lit(MERGE_GROUPS)))
    head = top_per_query(grouped, candidates, *order, keys=("query_id", "_group")).drop("_group")
    head = write_once(top_per_query(head, candidates, *order), "candidates")
    exact = head.join(index.table().where(F.col("cell").isin(wanted)).drop("code"), ["cell", "claim_id"])
    exact = exact.join(asked.select("query_id", F.col("embedding").alias("asked")), "query_id")
    exact = exact.select("query_id", "claim_id", _cosine_distance(F.col("embedding"), F.col("asked")).alias("distance"))
    hits = top_per_query(exact, n, F.col("distance"), F.col("claim_id"))
    sizes = index.sizes()
    seen = asked.select(F.explode("cells").alias("cell")).join(sizes, "cell").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("seen"))
    pairs = sizes.agg(F.sum("size")).scalar() * asked.agg(F.count("*")).scalar()
    return hits, seen.select((F.col("seen") / pairs).alias("scored_fraction"))


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected, found, recall): which share of the exact hits each query's hits hold."""
    right = hits.select("query_id", "claim_id", F.lit(1).alias("right"))
    joined = exact.select("query_id", "claim_id").join(right, ["query_id", "claim_id"], "left")
    counted = joined.groupBy("query_id").agg(F.count("*").alias("expected"), F.count("right").alias("found"))
    return counted.withColumn("recall", F.col("found") / F.col("expected"))
