"""Prefix tries of conversations in double arrays, built shard by shard and merged globally.

A conversation is the sequence of its turns (role and text), and a node of the trie is a sequence with which
one or more conversations begin. Turns are 128-bit fingerprints from the first scan on, and a node is known
everywhere by its depth and the XOR of its turns' fingerprints mixed with their places.

Conversations are dealt out by ranges of their beginnings, so that a shard holds conversations with common
prefixes, and a prefix that very many share is split by the turns that follow, and at last by the
conversation's id. A task takes its shard in slabs, numbers the turns of a slab densely and packs the slab's
trie level by level into the arrays BASE and CHECK: the child of state ``s`` by turn ``t`` is ``BASE[s] + t``
where ``CHECK`` of that slot is ``s``. The conversations then walk through the arrays and leave their share at
every node. Nodes of different slabs and shards are the same if their names are; Spark sums their shares.

What a subtree holds is a sum over its members, too, so that nothing is passed up the trie. A conversation
*owns* the nodes whose smallest member it is; those are the deepest ones of its path, from some depth on,
which the first walk finds. In a second walk every member that owns the child of a node counts as one child,
every member that owns the leaf where it ends counts as one leaf, and the characters a member shares with a
smaller one below a node are those between the node and the first turn of its own.

Long conversations are cut into bands of ``band`` turns that start from the XOR of what comes before, so
neither a long conversation nor a node of many members is ever gathered in one place. The ids that end at a
node are sorted by range and written as pieces of text by all tasks; one task only hashes the pieces.

Defined results: turns come in the order of turn (null first), role and text, and repeated rows are turns of
their own; null role or text is empty; rows without a conversation id belong to no conversation and are left
out; an empty table has no nodes, not even the root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lossweave.llm.arrays import U64, mix
from lossweave.llm.tables import pin, task_count

BAND = 1024
SLAB = 200_000  # turns whose trie a task holds at a time
_SECOND = U64(0xC2B2AE3D27D4EB4F)
_NODE = ["depth", "h1", "h2"]
_TURNS = "conv long, k1 long, k2 long, chars long, part int, nth long"
_WALK_1 = "depth long, h1 long, h2 long, p1 long, p2 long, n long, conv long, longest long, chars long, before long"
_WALK_2 = "depth long, h1 long, h2 long, shared long, children long, leaves long"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _count_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of a task inside their conversation."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy()
        if not len(conv):
            continue
        start = np.append(True, conv[1:] != conv[:-1])
        first = np.flatnonzero(start)
        nth = np.arange(1, len(conv) + 1) - np.repeat(first, np.diff(np.append(first, len(conv))))
        head = int(first[1]) if len(first) > 1 else len(conv)
        nth[:head] += seen if conv[0] == last else 0
        last, seen = conv[-1], int(nth[-1])
        yield _batch(_TURNS, [*(batch.column(c) for c in ("conv", "k1", "k2", "chars")), pa.array(np.full(len(conv), part, np.int32)), nth])


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv, nth, k1, k2, chars): every turn with its number in its conversation, from 1."""
    spark = conversations.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")
    ).where("conv is not null")
    rows = rows.select(
        "*", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "role").alias("k2"),
        F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"),
    )
    # the row's number splits a range of equal rows; which of them comes first makes no difference
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    own = pin(sorted_.select("conv", "k1", "k2", "chars").mapInArrow(_count_turns, _TURNS), "turns")
    ends = own.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "nth")).alias("last"))
    carried, last, held = [], None, 0
    for p in ends.orderBy("part").collect():  # a row per task
        before = held if p.first == last else 0
        carried.append((p.part, p.first, before))
        last, held = p["last"].conv, p["last"].nth + (before if p["last"].conv == p.first else 0)
    carried = F.broadcast(spark.createDataFrame(carried, "part int, first long, before long"))
    nth = F.col("nth") + F.when(F.col("conv") == F.col("first"), F.col("before")).otherwise(0)
    return own.join(carried, "part").select("conv", nth.alias("nth"), "k1", "k2", "chars")


def _items(conversations: DataFrame, group: int, heads: int, band: int) -> DataFrame:
    """A row per conversation and band: (conv, n, bands, band, offset, k1, k2, chars), ``n`` turns in all and the
    band's turns as arrays. With ``group`` a conversation's first turns are those of its group's first one."""
    turns = _numbered(conversations)
    convs = turns.groupBy("conv").agg(F.max("nth").alias("n_own"))
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % heads if group else F.lit(0).cast("long")
    row = F.struct("nth", "k1", "k2", "chars")
    place = F.floor((F.col("nth") - h - 1) / band).cast("long")
    own = turns.where(F.col("nth") > h).groupBy("conv", place.alias("band")).agg(F.array_sort(F.collect_list(row)).alias("own"))
    none = F.array().cast("array<struct<nth: bigint, k1: bigint, k2: bigint, chars: bigint>>")
    if group:
        first = turns.where((F.col("conv") % group == 0) & (F.col("nth") < heads))
        first = first.groupBy(F.col("conv").alias("head")).agg(F.array_sort(F.collect_list(row)).alias("first"))
        convs = convs.withColumn("head", F.col("conv") - F.col("conv") % group).join(first, "head", "left")
        convs = convs.withColumn("first", F.coalesce(F.filter("first", lambda t: t["nth"] <= h), none))
    else:
        convs = convs.withColumn("first", none)
    left = F.greatest(F.col("n_own") - h, F.lit(0))
    convs = convs.select(
        "conv", "first", (F.size("first") + left).cast("long").alias("n"), F.greatest(F.ceil(left / band), F.lit(1)).cast("long").alias("bands")
    )
    joined = convs.join(own, "conv", "left").withColumn("band", F.coalesce("band", F.lit(0).cast("long")))
    at_start = F.col("band") == 0
    held = F.concat(F.when(at_start, F.col("first")).otherwise(none), F.coalesce("own", none))
    offset = F.when(at_start, 0).otherwise(F.size("first") + F.col("band") * band).cast("long")
    return joined.select("conv", "n", "bands", "band", offset.alias("offset"), held.alias("held")).select(
        "conv", "n", "bands", "band", "offset", "held.k1", "held.k2", "held.chars"
    )


def _named(k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of turns at their places (from 1); a prefix is named by the XOR of its turns'."""
    at = place.astype(np.uint64)
    return mix(k1.view(np.uint64) ^ mix(at)), mix(k2.view(np.uint64) ^ mix(at ^ _SECOND))


class _Slab:
    """Items of a shard: flat turns with what lies before each of them."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.table = table
        lists = [table.column(c).chunk(0) for c in ("k1", "k2", "chars")]
        self.size = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.k1, self.k2, self.chars = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        self.which = np.repeat(np.arange(len(self.size)), self.size)
        self.offset = self.column("offset")
        place = np.arange(len(self.k1)) - self.at[self.which] + self.offset[self.which] + 1
        self.z = _named(self.k1, self.k2, place)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy().astype(np.int64)

    def totals(self, values: np.ndarray, how) -> np.ndarray:
        out = np.zeros(len(self.size), values.dtype)
        some = self.size > 0
        if some.any():
            out[some] = how.reduceat(values, self.at[some])
        return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the XORs and the characters of whole items."""
    for batch in batches:
        if not batch.num_rows:
            continue
        slab = _Slab([batch])
        ends = [slab.totals(z, np.bitwise_xor).view(np.int64) for z in slab.z]
        extra = [pa.array(c) for c in (*ends, slab.totals(slab.chars, np.add))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "x1", "x2", "total"])


class DoubleArray:
    """BASE and CHECK of a trie over dense symbols; state 0 is its root."""

    def __init__(self, symbols: int):
        self.used = bytearray(symbols + 2)
        self.used[0] = 1
        self.base, self.check = [0] * len(self.used), [-1] * len(self.used)
        self.low = 1

    def _grow(self, size: int) -> None:
        more = size - len(self.used)
        if more > 0:
            more = max(more, len(self.used) // 2)
            self.used.extend(bytes(more))
            self.base.extend([0] * more)
            self.check.extend([-1] * more)

    def put(self, state: int, symbols: list[int]) -> int:
        """Gives a state its children: the least base from the lowest free slot on that has room for all."""
        used, first = self.used, symbols[0]
        slot = used.find(0, max(self.low, first))
        for _ in range(64):
            if slot < 0:
                break
            base = slot - first
            self._grow(base + symbols[-1] + 1)
            if not any(used[base + s] for s in symbols):
                break
            slot = used.find(0, slot + 1)
        else:
            slot = -1
        if slot < 0:
            base = max(len(used.rstrip(b"\0")), first) - first
            self._grow(base + symbols[-1] + 1)
        self.base[state] = base
        for s in symbols:
            used[base + s] = 1
            self.check[base + s] = state
        low = used.find(0, self.low)
        self.low = low if low >= 0 else len(used)
        return base


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal numbers from 1 on, without gaps; also the largest number."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def _walk(slab: _Slab):
    """Packs the slab's trie level by level and walks its items through it. Yields per level the items that
    reach it, for each its node's number, per node one of its items, and the level (0 for where items start)."""
    starts, n_starts = _dense(slab.offset, slab.column("s1"), slab.column("s2"))
    symbols, n_symbols = _dense(slab.k1, slab.k2)
    trie = DoubleArray(n_starts + n_symbols)
    symbols += n_starts
    width = n_starts + n_symbols + 1
    items, state = np.arange(len(slab.size)), np.zeros(len(slab.size), np.int64)
    level = 0
    while len(items):
        step = starts if not level else symbols[slab.at[items] + level - 1]
        pairs, one, node = np.unique(state * width + step, return_index=True, return_inverse=True)
        parents, children = pairs // width, pairs % width
        bounds = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        listed, slots = children.tolist(), np.empty(len(pairs), np.int64)
        for a, b, parent in zip(bounds.tolist(), [*bounds[1:].tolist(), len(listed)], parents[bounds].tolist()):
            slots[a:b] = trie.put(parent, listed[a:b])
        slots += children
        state = slots[node]
        yield items, node, items[one], level
        stay = slab.size[items] > level
        items, state = items[stay], state[stay]
        level += 1


def _first_walk(slab: _Slab) -> Iterator[pa.RecordBatch]:
    conv, n, s1, s2, before = (slab.column(c) for c in ("conv", "n", "s1", "s2", "before"))
    start = (s1.view(np.uint64), s2.view(np.uint64))
    sums = [np.bitwise_xor.accumulate(z) if len(z) else z for z in slab.z]
    chars = np.cumsum(slab.chars)

    def prefix(which: int, of: np.ndarray, count: int) -> np.ndarray:
        """XOR of what lies before the items and their first ``count`` turns."""
        out = start[which][of].copy()
        if count:
            last = slab.at[of] + count - 1
            out ^= sums[which][last]
            out ^= np.where(slab.at[of] > 0, sums[which][slab.at[of] - 1], U64(0))
        return out.view(np.int64)

    for items, node, one, level in _walk(slab):
        if not level:
            real = slab.offset[one] == 0  # the root; others are nodes of the band before
            if not real.any():
                continue
            keep = real[node]
            items, node, one = items[keep], np.zeros(int(keep.sum()), np.int64), one[real]
        count = len(one)
        least, longest = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
        np.minimum.at(least, node, conv[items])
        np.maximum.at(longest, node, n[items])
        zero = np.zeros(count, np.int64)
        last = slab.at[one] + level - 1
        gone = chars[last] - slab.chars[last] - np.where(slab.at[one] > 0, chars[slab.at[one] - 1], 0) if level else zero
        parent = [prefix(k, one, level - 1) for k in (0, 1)] if level else [zero, zero]
        yield _batch(
            _WALK_1,
            [slab.offset[one] + level, prefix(0, one, level), prefix(1, one, level), *parent, np.bincount(node, minlength=count).astype(np.int64),
             least, longest, slab.chars[last] if level else zero, before[one] + gone],
        )


def _second_walk(slab: _Slab) -> Iterator[pa.RecordBatch]:
    n, owned, spared, leaf, s1, s2 = (slab.column(c) for c in ("n", "owned", "spared", "leaf", "s1", "s2"))
    sums = [np.bitwise_xor.accumulate(z) if len(z) else z for z in slab.z]
    for items, node, one, level in _walk(slab):
        if not level:
            real = slab.offset[one] == 0
            if not real.any():
                continue
            keep = real[node]
            items, node, one = items[keep], np.zeros(int(keep.sum()), np.int64), one[real]
        depth = slab.offset[one] + level
        own = depth[node]
        shares = [np.zeros(len(one), np.int64) for _ in range(3)]
        np.add.at(shares[0], node, np.where(owned[items] > own, spared[items], 0))
        np.add.at(shares[1], node, ((owned[items] <= own + 1) & (n[items] > own)).astype(np.int64))
        np.add.at(shares[2], node, leaf[items])
        names = []
        for z, s in zip(sums, (s1, s2)):
            name = s.view(np.uint64)[one].copy()
            if level:
                name ^= z[slab.at[one] + level - 1] ^ np.where(slab.at[one] > 0, z[slab.at[one] - 1], U64(0))
            names.append(name.view(np.int64))
        yield _batch(_WALK_2, [depth, *names, *shares])


def _by_slabs(walk, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if not part.num_rows:
                    continue
                held.append(part)
                turns += part.num_rows + len(part.column("k1").flatten())
                if turns >= slab:
                    yield from walk(_Slab(held))
                    held, turns = [], 0
        if held:
            yield from walk(_Slab(held))

    return run


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, h1, h2, conv) rows to pieces of comma-joined ids of one node each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in _NODE])
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        ids = batch.column("conv").to_pylist()
        stops = [*first[1:].tolist(), len(ids)]
        texts = [",".join(map(str, ids[a:b])).encode() for a, b in zip(first.tolist(), stops)]
        yield _batch("depth, h1, h2, first, ids", [*key[:, first], pa.array([ids[a] for a in first.tolist()], pa.int64()), pa.array(texts, pa.binary())])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 per node; one state is held at a time."""
    now, state = None, None
    done: list[tuple] = []
    out = lambda: _batch("depth, h1, h2, ends", [*(pa.array([d[k] for d in done], pa.int64()) for k in range(3)), pa.array([d[3] for d in done], pa.string())])
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if key == now:
                state.update(b"," + ids)
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(ids)
        if done:
            yield out()
            done = []
    if now is not None:
        done.append((*now, state.hexdigest()))
        yield out()


def _ends(members: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends): the hash of the sorted ids of each node's conversations that end there."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = members.repartitionByRange(tasks, *_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    pieces = sorted_.mapInArrow(_id_pieces, "depth long, h1 long, h2 long, first long, ids binary")
    pieces = pieces.repartition(tasks, *_NODE).sortWithinPartitions(*_NODE, "first")
    return pieces.mapInArrow(_hash_pieces, "depth long, h1 long, h2 long, ends string")


def _sharded(items: DataFrame, walk, schema: str, slab: int, tasks: int) -> DataFrame:
    start = [F.get("k1", F.lit(k)) for k in range(3)]
    return items.repartitionByRange(tasks, "s1", *start, "conv").mapInArrow(_by_slabs(walk, slab), schema)


def prefix_nodes(conversations: DataFrame, group: int = 0, heads: int = 6, band: int = BAND, slab: int = SLAB) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256);
    ``conv_id`` is the smallest member. With ``group`` conversations are rebuilt first: conversation c gets the
    first h < ``heads`` turns of conversation c - c % group in place of its own first h, h by the crc32 of c."""
    spark = conversations.sparkSession
    items = pin(_items(conversations, group, heads, band), "bands")
    schema = T.StructType([*items.schema.fields, *(T.StructField(c, T.LongType()) for c in ("x1", "x2", "total"))])
    items = pin(items.mapInArrow(_measure, schema), "bands-named")
    zero = F.lit(0).cast("long")
    # what lies before a later band: one row per band, not per turn
    earlier = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda e: F.coalesce(e.over(earlier), zero)
    later = items.where("bands > 1").select(
        "conv", "band", over(F.bit_xor("x1")).alias("s1"), over(F.bit_xor("x2")).alias("s2"), over(F.sum("total")).alias("before")
    ).where("band > 0")
    first = items.where("band = 0").withColumns({"s1": zero, "s2": zero, "before": zero})
    items = pin(first.unionByName(items.where("band > 0").join(later, ["conv", "band"])), "bands-placed")
    tasks = task_count(spark, items.count(), 100_000)

    walked = _sharded(items, _first_walk, _WALK_1, slab, tasks).groupBy(*_NODE)
    same = [F.max(c).alias(c) for c in ("p1", "p2", "chars", "before")]
    nodes = walked.agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("longest").alias("longest"), *same)
    nodes = pin(nodes, "nodes")

    ended = items.where("band = bands - 1").select(
        "conv", F.col("n").alias("depth"), F.col("s1").bitwiseXOR(F.col("x1")).alias("h1"),
        F.col("s2").bitwiseXOR(F.col("x2")).alias("h2"), (F.col("before") + F.col("total")).alias("all"),
    )
    is_leaf: Column = (F.col("longest") == F.col("depth")).cast("long")
    owners = nodes.groupBy("conv").agg(F.min(F.struct("depth", "before")).alias("from"), F.max(is_leaf).alias("leaf"))
    owned = ended.join(owners, "conv", "left").select(
        "conv", F.coalesce("from.depth", F.col("depth") + 1).alias("owned"), F.coalesce("from.before", F.col("all")).alias("spared"),
        F.coalesce("leaf", zero).alias("leaf"),
    )
    weighed = pin(items.drop("x1", "x2", "total", "bands", "band").join(owned, "conv"), "bands-weighed")
    shares = _sharded(weighed, _second_walk, _WALK_2, slab, tasks)

    rows = shares.unionByName(_ends(ended.select(*_NODE, "conv")), allowMissingColumns=True)
    rows = rows.unionByName(nodes.select(*_NODE, "n", "conv", "before", "p1", "p2"), allowMissingColumns=True)
    merged = rows.groupBy(*_NODE).agg(
        *[F.max(c).alias(c) for c in ("n", "conv", "before", "p1", "p2", "ends")], *[F.sum(c).alias(c) for c in ("shared", "children", "leaves")]
    )
    merged = pin(merged, "nodes-merged")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("parent"))
    # all of the first turns' nodes have the root as their parent: no join for them
    root = nodes.where("depth = 0").select("conv").scalar()
    deep = merged.where("depth > 1").join(parents.where("depth > 1"), ["depth", "p1", "p2"])
    top = merged.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, root))
    saved = F.col("shared") - (F.col("n") - 1) * F.col("before")
    return deep.unionByName(top).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_nodes_sql(group: int = 100, heads: int = 6) -> str:
    """The same in SQL: a node is its smallest member and depth."""
    crc = (
        "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
        "lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    )
    return f"""WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (SELECT conv_id, count(*) AS n FROM o GROUP BY 1), c AS (
  SELECT k.conv_id, k.conv_id - k.conv_id % {group} AS head, {crc.replace("conv_id", "k.conv_id")} % {heads} AS h FROM k
), r AS (
  SELECT c.conv_id, nth AS depth, role, text FROM c JOIN o ON o.conv_id = c.head AND nth <= h
  UNION ALL
  SELECT c.conv_id, least(h, coalesce(k.n, 0)) + nth - h, role, text FROM c JOIN o USING (conv_id) LEFT JOIN k ON k.conv_id = c.head WHERE nth > h
), p AS (
  SELECT conv_id, depth, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, '', CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]) FROM c
), m AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM p),
n AS (SELECT node, depth, count(*) AS n_convs, max(length(text)) AS chars FROM m GROUP BY 1, 2),
t AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
ch AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM t WHERE parent IS NOT NULL GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (node, depth)),
s AS (
  SELECT m.node, m.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM v JOIN m ON m.conv_id = v.node AND m.depth <= v.depth GROUP BY 1, 2
), e AS (
  SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY 1) USING (conv_id, depth) GROUP BY 1, 2
)
SELECT node AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM v JOIN t USING (node, depth, n_convs, chars) JOIN s USING (node, depth) LEFT JOIN e USING (node, depth)"""
