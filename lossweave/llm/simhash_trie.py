"""SimHash near-duplicates: a self-join over a binary trie of fingerprints.

Fingerprints: whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words
(repeats included), XXH64 with seed 42; a bit is set if it is set in over half of the hashes. Texts
without a word (null, empty, white space) have fingerprint zero and are linked like any other.

Search: two fingerprints that differ in at most d bits agree in one of d + 1 blocks of bits. For each
block the trie reads that block first, so its top level splits the work into subtrees that Spark deals
out by key. Inside a subtree pairs of nodes are walked together: children are paired, a pair of unlike
children costs one bit, and pairs over the budget are pruned with all that is below them. A subtree with
more than ``node_limit`` fingerprints is split by Spark into pairs of deeper nodes, again and again, before
it is walked. Each walk returns a spanning forest of its links, never all pairs.

Defined results: rows with a null id are kept and get their group's smallest id (null if there is none);
repeated ids give one output row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.components import connected_components
from lossweave.llm.tables import pin, task_count

BITS = 64
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        grams = zip(*(words[i:] for i in range(shingle)))
        hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    total = len(hashes)
    ones = np.zeros(BITS, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, total, 1 << 16):
        part = values[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def walk(values: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk pairs of trie nodes. A node is a range of ``values`` (distinct and ascending inside it) that
    shares its first ``depth`` bits; ``pairs`` has rows (lo1, hi1, lo2, hi2, spent bits). Yields index
    arrays of values that differ in at most ``budget`` bits."""
    for bit in range(BITS - 1 - depth, -2, -1):
        lo1, hi1, lo2, hi2, spent = pairs.T
        alike = lo1 == lo2
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1) & ~alike
        if leaf.any():
            i, j = lo1[leaf], lo2[leaf]
            near = _popcount(values[i] ^ values[j]) <= budget
            yield i[near], j[near]
        pairs = pairs[~leaf & ~(alike & (hi1 - lo1 == 1))]
        if not len(pairs) or bit < 0:
            return
        ones = np.zeros(len(values) + 1, np.int64)
        np.cumsum((values >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        lo1, hi1, lo2, hi2, spent = pairs.T
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        alike = lo1 == lo2
        children = [
            np.stack([lo1, mid1, lo2, mid2, spent], 1),
            np.stack([mid1, hi1, mid2, hi2, spent], 1),
            np.stack([lo1, mid1, mid2, hi2, spent + 1], 1),
            np.stack([mid1, hi1, lo2, mid2, spent + 1], 1)[~alike],
        ]
        pairs = np.concatenate(children)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]


class _Forest:
    """Union-find over indices; ``join`` tells whether an edge linked two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[x] = y
        return x != y


def _forest_edges(values: np.ndarray, starts: np.ndarray, a_ends: np.ndarray, ends: np.ndarray, depth: int, budget: int):
    """Spanning forest of the links of node pairs that lie one after the other in ``values``; in a pair of
    unlike nodes the first one ends at ``a_ends``."""
    alone = a_ends == ends
    lo2 = np.where(alone, starts, a_ends)
    shift = np.uint64(BITS - depth)
    spent = np.where(alone, 0, _popcount((values[starts] >> shift) ^ (values[lo2] >> shift)) if depth else 0)
    forest = _Forest()
    for i, j in walk(values, np.stack([starts, a_ends, lo2, ends, spent], 1), depth, budget):
        for x, y in zip(i.tolist(), j.tolist()):
            if forest.join(x, y):
                yield x, y


def _links_of_nodes(depth: int, budget: int, batch_rows: int = 200_000):
    """Task over rows (turn, pa, pb, fp) sorted by node pair and side: walks whole node pairs, many at a time."""

    def turned_back(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
        turn = turn.astype(np.uint64)
        return np.where(turn == 0, x, (x >> turn) | (x << (np.uint64(BITS) - turn) % np.uint64(BITS)))

    def links(turn, pa_, pb, side, fp) -> pa.RecordBatch:
        change = (np.diff(turn) != 0) | (np.diff(pa_) != 0) | (np.diff(pb) != 0)
        starts = np.flatnonzero(np.append(True, change))
        ends = np.append(starts[1:], len(fp))
        a_ends = starts + np.add.reduceat(side == 0, starts)
        both = (ends - starts > 1) & (a_ends > starts) & ((a_ends < ends) | (pa_[starts] == pb[starts]))
        values = fp.view(np.uint64)
        edges = np.array(
            list(_forest_edges(values, starts[both], a_ends[both], ends[both], depth, budget)), np.int64
        ).reshape(-1, 2)
        ends_ = [turned_back(values[edges[:, k]], turn[edges[:, k]]).view(np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends_], schema=_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            rows += batch.num_rows
            if rows >= batch_rows:
                table = np.concatenate(held, axis=1)
                change = np.flatnonzero((np.diff(table[:3]) != 0).any(axis=0))
                if len(change):
                    cut = int(change[-1]) + 1
                    yield links(*np.ascontiguousarray(table[:, :cut]))
                    table = np.ascontiguousarray(table[:, cut:])
                held, rows = [table], table.shape[1]
        if rows:
            yield links(*np.ascontiguousarray(np.concatenate(held, axis=1)))

    return run


def _rotated(fp, turn: int):
    if not turn:
        return fp
    return F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn))


def _split(nodes: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """Deal the rows of node pairs out to pairs of nodes ``step`` bits deeper, within the budget."""
    flips = [m for m in range(1 << step) if m.bit_count() <= budget]
    width = depth + step
    own = F.shiftrightunsigned("fp", BITS - width)
    low = own.bitwiseAND(F.lit((1 << step) - 1))
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in flips]))
    other_parent = F.when(F.col("side") == 0, F.col("pb")).otherwise(F.col("pa"))
    rows = nodes.withColumn("own", own).withColumn("mask", masks)
    partner = F.shiftleft(other_parent, step).bitwiseOR(low.bitwiseXOR(F.col("mask")))
    rows = rows.withColumn("partner", partner)
    within = F.bit_count(F.col("own").bitwiseXOR(F.col("partner"))) <= budget
    same = F.col("pa") == F.col("pb")
    side = F.when(same, F.when(F.col("own") <= F.col("partner"), 0).otherwise(1)).otherwise(F.col("side"))
    rows = rows.where(within).withColumn("side", side.cast("int"))
    first = F.col("side") == 0
    return rows.select(
        "turn",
        F.when(first, F.col("own")).otherwise(F.col("partner")).alias("pa"),
        F.when(first, F.col("partner")).otherwise(F.col("own")).alias("pb"),
        "side",
        "fp",
    )


def links(prints: DataFrame, budget: int = 2, node_limit: int = 50_000, step: int = 4) -> DataFrame:
    """(u, v): links between the distinct fingerprints in column ``fp`` that span the same components as
    all links of at most ``budget`` differing bits."""
    spark = prints.sparkSession
    blocks = [BITS * (i + 1) // (budget + 1) - BITS * i // (budget + 1) for i in range(budget + 1)]
    depth = min(blocks)
    turns = [sum(blocks[:i]) for i in range(len(blocks))]
    by_turn = F.explode(
        F.array(*[F.struct(F.lit(t).alias("turn"), _rotated(F.col("fp"), t).alias("fp")) for t in turns])
    )
    nodes = prints.select(by_turn.alias("x")).select("x.turn", "x.fp")
    prefix = F.shiftrightunsigned("fp", BITS - depth)
    nodes = nodes.select("turn", prefix.alias("pa"), prefix.alias("pb"), F.lit(0).alias("side"), "fp")
    found = None
    while True:
        key = ["turn", "pa", "pb"]
        sides = nodes.groupBy(*key).agg(
            F.count("*").alias("rows"), F.min("side").alias("least"), F.max("side").alias("most")
        )
        large = (
            sides.where((F.col("rows") > node_limit) & ((F.col("pa") == F.col("pb")) | (F.col("least") < F.col("most"))))
            if depth < BITS
            else sides.limit(0)
        )
        large = pin(large.select(*key), "trie-large")
        none_large = large.isEmpty()
        small = nodes if none_large else nodes.join(large, key, "left_anti")
        walked = (
            small.select(*key, "side", "fp")
            .repartition(*[F.col(c) for c in key])
            # unsigned order inside a node: its values share the leading bits
            .sortWithinPartitions(*key, "side", F.col("fp").bitwiseXOR(F.lit(-(2**63))))
            .mapInArrow(_links_of_nodes(depth, budget), "u long, v long")
        )
        found = walked if found is None else found.unionByName(walked)
        if none_large:
            return found
        bits = min(step, BITS - depth)
        nodes = pin(_split(nodes.join(large, key, "left_semi"), depth, bits, budget), "trie-nodes")
        depth += bits


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, node_limit: int = 50_000) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document. ``component_id`` is the smallest id
    reachable over links of at most ``max_distance`` differing bits."""
    prints = pin(fingerprints(docs, shingle), "simhash")
    classes = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    edges = links(classes.select("fp"), max_distance, node_limit)
    roots = connected_components(edges)
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "first")
    tops = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(tops, "root").select(F.col("fp").alias("moved_fp"), "component_id")
    final = classes.join(moved, classes.fp == moved.moved_fp, "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component_id", "first").alias("component_id")
    )
    return prints.join(final, prints.fp == final.class_fp).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
