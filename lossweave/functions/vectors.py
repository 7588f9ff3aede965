"""Vector expressions and the Arrow batch kernels that score vectors inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The kernels travel with the tasks that use them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distances are compared at this many decimals, so that equal vectors tie exactly.
DISTANCE_DECIMALS = 12

# Size of the score matrix a task holds at a time.
_SCORES_AT_ONCE = 2_000_000


def unit_vector(vector: Column) -> Column:
    """L2-normalised vector of doubles; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def as_matrix(column: pa.Array) -> np.ndarray:
    """List column of equal-length vectors as a matrix of doubles."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    width = len(flat) // len(column) if len(column) else 0
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if np.any(sizes != width):
        raise ValueError("vectors differ in length, or some are missing")
    return flat.reshape(len(column), width)


def rounded(distances: np.ndarray) -> np.ndarray:
    """Distances ready for comparison, without negative zeros."""
    return np.round(distances, DISTANCE_DECIMALS) + 0.0


def stored_files(path: str, slot: int) -> Iterator[pa.Table]:
    """The Parquet files of one block in shared storage, as tables."""
    where, root = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    found = where.get_file_info(fs.FileSelector(f"{root}/slot={slot}", allow_not_found=True, recursive=True))
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            yield pq.read_table(info.path, filesystem=where, partitioning=None)


def stored_block(path: str, slot: int) -> tuple[pa.Table, np.ndarray] | None:
    """One block's rows (id, vector, ...) in id order, and its unit vectors; None for an empty block."""
    tables = list(stored_files(path, slot))
    table = pa.concat_tables(tables) if tables else None
    if table is None or not table.num_rows:
        return None
    table = table.sort_by(table.column_names[0]).combine_chunks()
    return table, unit_rows(as_matrix(table.column(1).chunk(0)))


class Nearest:
    """Keeps the n nearest rows per query over slices of rows that are numbered in id order. ``bound`` may give
    distances that the n-th nearest of each query is known not to exceed, and ``last`` the row from which on
    rows of just that distance come too late."""

    def __init__(self, n_queries: int, n: int, bound: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        self.n, self.limit = n, 4 * n * max(1, n_queries)
        self.first, self.last = (None, None) if bound is None else (bound.copy(), last)
        self.bound = np.full(n_queries, np.inf) if bound is None else bound.astype(np.float64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, queries: np.ndarray, distances: np.ndarray) -> None:
        """``distances`` holds one line per row and one column per entry of ``queries``."""
        if len(rows) >= self.n and np.isinf(self.bound[queries]).any():
            kth = np.partition(distances, self.n - 1, axis=0)[self.n - 1]
            self.bound[queries] = np.minimum(self.bound[queries], kth)
        near = distances <= self.bound[queries][None, :]
        if self.last is not None:
            near &= (distances < self.first[queries][None, :]) | (rows[:, None] < self.last[queries][None, :])
        line, col = np.nonzero(near)
        self.held.append((queries[col], distances[line, col], rows[line]))
        self.size += len(line)
        if self.size > self.limit:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, row) of what is nearest so far; of equal distances the lower row is nearer."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        query, distance, row = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((row, distance, query))
        query, distance, row = query[order], distance[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = place == self.n - 1
        self.bound[query[last]] = np.minimum(self.bound[query[last]], distance[last])
        keep = place < self.n
        self.held = [(query[keep], distance[keep], row[keep])]
        self.size = int(keep.sum())
        self.limit = max(self.limit, 2 * self.size)
        return self.held[0]


def chunks(batches: Iterable[pa.RecordBatch], size: int = 64 << 20) -> Iterator[pa.Table]:
    """Rows of a task in chunks of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _spread_rows(matrix: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each one is the furthest from those before it."""
    picked, gap = [0], np.full(len(matrix), np.inf)
    while len(picked) < count:
        gap = np.minimum(gap, ((matrix - matrix[picked[-1]]) ** 2).sum(axis=1))
        picked.append(int(np.argmax(gap)))
    return matrix[picked]


class Balls:
    """Rows in groups with the centre and the radius of each: a query further from a centre than the radius
    and its bound allow needs no row of the group."""

    def __init__(self, matrix: np.ndarray, cells: np.ndarray | None = None, most: int = 64, least_rows: int = 256) -> None:
        if cells is None:
            count = max(1, min(most, len(matrix) // least_rows))
            pivots = _spread_rows(matrix[:: max(1, len(matrix) // 2048)], count)
            near = np.empty(len(matrix), np.int64)
            for at in range(0, len(matrix), 65_536):
                near[at : at + 65_536] = np.argmax(matrix[at : at + 65_536] @ pivots.T, axis=1)
        else:
            near = cells
        order = np.argsort(near, kind="stable")
        self.names, starts = np.unique(near[order], return_index=True)
        self.members = np.split(order, starts[1:])
        self.centres = np.stack([matrix[m].mean(axis=0) for m in self.members])
        self.radii = np.array([np.sqrt(((matrix[m] - c) ** 2).sum(axis=1).max()) for m, c in zip(self.members, self.centres)])

    def least(self, queries: np.ndarray) -> np.ndarray:
        """Per query (line) and group a lower bound of the cosine distance: half the squared gap of unit vectors."""
        squares = (queries**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * queries @ self.centres.T
        gap = np.maximum(np.sqrt(np.maximum(squares, 0.0)) - self.radii, 0.0)
        return gap**2 / 2 - 1e-9


def _askers(table: pa.Table, column: str) -> dict[int, np.ndarray]:
    """Which rows of a block of queries ask for each cell."""
    lists = table.column(column).chunk(0)
    asker = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    wanted = lists.flatten().to_numpy(zero_copy_only=False)
    return {int(c): asker[wanted == c] for c in np.unique(wanted)}


def _best_of(tables: list[pa.Table], n: int) -> pa.Table:
    """The n nearest hits per query of several tables (query_id, claim_id, distance), ties in id order."""
    table = pa.concat_tables(tables).sort_by([("query_id", "ascending"), ("distance", "ascending"), ("claim_id", "ascending")])
    query = table.column("query_id").combine_chunks().dictionary_encode()
    query = (query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query).indices.to_numpy(zero_copy_only=False)
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return table.filter(pa.array(place < n))


def nearest_batches(
    batches: Iterable[pa.RecordBatch], path: str, slots: int, n: int, by_cell: bool, hold: int = 256 << 20, seen: list | None = None
) -> Iterator[pa.RecordBatch]:
    """The nearest rows of one task as (query_id, claim_id, distance): n per query at most, and none beyond the
    query's bound.

    Batches hold claim_id, embedding and, with ``by_cell``, a cell. Queries come block by block from shared
    storage (query_id, embedding, bound, bound_id and, with ``by_cell``, their cells), once for ``hold`` bytes of claims;
    one block is held at a time, and of a task with more claims the best hits so far. ``seen`` gathers the
    numbers of scored pairs."""
    held: dict[int, pa.Table] = {}
    for chunk in chunks(batches, hold):
        chunk = chunk.sort_by("claim_id").combine_chunks()
        ids, matrix = chunk.column(0).chunk(0), unit_rows(as_matrix(chunk.column(1).chunk(0)))
        balls = Balls(matrix, chunk.column(2).to_numpy() if by_cell else None)
        for slot in range(slots):
            block = stored_block(path, slot)
            if block is None:
                continue
            table, queries = block
            bound = table.column("bound").to_numpy().copy()
            nearer = None
            if slot in held:
                known = held[slot].group_by("query_id").aggregate([("distance", "max"), ("distance", "count")])
                full = {q: d for q, d, c in zip(*(known.column(c).to_pylist() for c in ("query_id", "distance_max", "distance_count"))) if c == n}
                nearer = np.array([full.get(q, np.inf) for q in table.column(0).to_pylist()])
            # of the rows as far as the bound, those up to its id
            own = table.column("bound_id").fill_null("").to_pylist()
            names = ids.to_numpy(zero_copy_only=False)
            last = np.array([np.searchsorted(names, o, "right") if o else len(names) for o in own], np.int64)
            best = Nearest(len(queries), n, bound, last)
            if nearer is not None:
                best.bound = np.minimum(best.bound, nearer)
            askers = _askers(table, "cells") if by_cell else None
            least = balls.least(queries)
            for group in np.argsort(least.min(axis=0), kind="stable").tolist():
                asking = np.arange(len(queries)) if askers is None else askers.get(int(balls.names[group]), np.zeros(0, np.int64))
                asking = asking[least[asking, group] <= best.bound[asking]]
                if not len(asking):
                    continue
                members = balls.members[group]
                step = max(1, _SCORES_AT_ONCE // len(asking))
                for start in range(0, len(members), step):
                    part = members[start : start + step]
                    best.add(part, asking, rounded(1.0 - matrix[part] @ queries[asking].T))
                if seen is not None:
                    seen.append(len(members) * len(asking))
            query, distance, row = best.best()
            found = pa.table([table.column(0).chunk(0).take(pa.array(query)), ids.take(pa.array(row)), pa.array(distance)], ["query_id", "claim_id", "distance"])
            held[slot] = _best_of([held[slot], found], n) if slot in held else found
    for found in held.values():
        yield from found.to_batches(max_chunksize=65_536)


def closest_batches(batches: Iterable[pa.RecordBatch], path: str, slots: int) -> Iterator[pa.RecordBatch]:
    """For each row its nearest target by cosine distance; of equal ones the target with the lower id. Targets
    (id, vector) come block by block from shared storage."""
    for chunk in chunks(batches):
        chunk = chunk.combine_chunks()
        vectors = chunk.column(1).chunk(0)
        distance = np.full(chunk.num_rows, np.inf)
        target = np.zeros(chunk.num_rows, np.int32)
        for slot in range(slots):
            block = stored_block(path, slot)
            if block is None:
                continue
            names, matrix = block[0].column(0).to_numpy(), block[1]
            step = max(1, _SCORES_AT_ONCE // len(matrix))
            for start in range(0, chunk.num_rows, step):
                here = slice(start, min(start + step, chunk.num_rows))
                scores = rounded(1.0 - unit_rows(as_matrix(vectors[here])) @ matrix.T)
                pick = np.argmin(scores, axis=1)
                value = scores[np.arange(len(pick)), pick]
                nearer = (value < distance[here]) | ((value == distance[here]) & (names[pick] < target[here]))
                distance[here] = np.where(nearer, value, distance[here])
                target[here] = np.where(nearer, names[pick], target[here])
        yield pa.RecordBatch.from_arrays(
            [chunk.column(0).chunk(0), pa.array(target), pa.array(distance)], names=["claim_id", "cluster_id", "distance"]
        )
