import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lossweave.llm.prefix_trie import DoubleArray, prefix_nodes, prefix_nodes_sql

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, group):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if group else 0
        paths[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:]) if group else tuple(turns)
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = set(), {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[node]]
        leaves = sum(x[0] for x in below) or 1
        sums[node] = leaves, sum(x[1] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(60), *range(100, 130), *range(250, 260), 1_000_003, 1_000_077]:
        for t in range(draw.choice([1, 2, 3, 6, 9])):
            text = draw.choice(["hi", "ça va 𝄞", "", None, "x" * 50])
            rows.append((c, draw.choice([t, t, None]), draw.choice(["user", "bot", None]), text))
    rows += rows[:9] + [(None, 0, "user", "lost"), (7, 3, "a", "tie"), (7, 3, "a", "tie")]
    return rows + [(c, t, "u", "same") for c in range(400, 440) for t in range(4)]


def collected(df):
    assert df.columns == list(COLUMNS)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("group, band, slab", [(100, 1024, 200_000), (100, 2, 25), (0, 3, 40)])
def test_against_brute_force(spark, group, band, slab):
    rows = rows_of(band)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({"conv": F.lit("c"), "k1": F.lit(1), "a.b": F.lit(2)})
    assert collected(prefix_nodes(df, group, band=band, slab=slab)) == brute(rows, group)


def test_against_sql(spark):
    rows = rows_of(5)
    con = duckdb.connect()
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    con.register("conversations", pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), zip(*rows), types)}))
    assert collected(prefix_nodes(spark.createDataFrame(rows, SCHEMA), 100)) == set(con.execute(prefix_nodes_sql()).fetchall())


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(5, t, "u", f"t{t % 97}") for t in range(3000)] + [(6, t, "u", f"t{t % 97}") for t in range(2000)]
    rows += [(c, t, "v", "long " * 2000) for c in range(100, 400) for t in range(2)]
    assert collected(prefix_nodes(spark.createDataFrame(rows, SCHEMA), band=64, slab=500)) == brute(rows, 0)


def test_empty_table(spark):
    assert prefix_nodes(spark.createDataFrame([], SCHEMA), 100).count() == 0
    assert prefix_nodes(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA), 100).count() == 0


def test_double_array_holds_every_child():
    draw, trie, kids = random.Random(3), DoubleArray(50), {}
    states = [0]
    for _ in range(300):
        state = states.pop(draw.randrange(len(states)))
        kids[state] = sorted(draw.sample(range(1, 51), draw.choice([1, 2, 20])))
        base = trie.put(state, kids[state])
        states += [base + s for s in kids[state]]
    for state, symbols in kids.items():
        found = [s for s in range(1, 51) if trie.base[state] + s < len(trie.check) and trie.check[trie.base[state] + s] == state]
        assert found == symbols
