"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every source has a weight and shares the words of all documents by it. A target stops at ``most`` times the
source's own words, and what is above goes to the other sources by their weights, until no target is above
its limit (a common level, raised until nothing changes). A document of the source is then wanted ``target /
source_size`` times: a whole number of copies and a fraction.

The fractions are rounded in pairs. Two documents exchange words (their fraction times their size) at random,
as many as it takes until one of them is wanted wholly or not at all, with odds that leave both expectations
as they were. The one that is settled leaves, the other one meets the next document. Each exchange moves words
from one document of the source to another, so the source's words never change. Bounded random chunks of a
source are rounded each on their own, the fractions left over are dealt into fewer chunks and rounded again,
level by level, until one document is left of each source: of this one the mix takes the part that is left,
so that a source has its target to within one word.

Rows of equal id, source and size are counted first: of ``n`` such rows with fraction ``f`` the whole part of
``n * f`` gets a copy more and one row enters with the rest, so a document that is repeated a million times
is one item, and is dealt out again over all tasks at the end. All draws are hashes of the documents: reruns
agree, however the rows are laid out.

Defined results: null text has no words; null is a source like any other, the last one; documents without an
id are mixed like all others; documents without words and sources without words have 0 taken (a source
without words still counts in the order of the weights); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossweave.llm.tables import pin

CHUNK = 256  # documents that are rounded together
ROWS = 4096  # equal rows that one task writes out at a time
BROADCAST = 32 << 20  # bytes of source names
_NEAR = 1e-12  # fractions closer to a whole number are whole
_WHITE = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, without a list of them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_WHITE}]*[^{_WHITE}]+[{_WHITE}]*", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def _ranked(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: the weights repeat in the order of the sources, which are sorted by range over tasks."""
    order = F.asc_nulls_last("source")
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sources.repartitionByRange(tasks, order).sortWithinPartitions(order)
    # a number's upper bits name the task, the lower ones count its rows in order
    placed = pin(placed.withColumn("number", F.monotonically_increasing_id()), "sources-in-order")
    task = F.shiftright("number", 33)
    held = placed.groupBy(task.alias("task")).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.orderBy("task")) - F.col("held")  # a row per task
    offsets = held.select("task", before.alias("before"))
    place = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    return placed.join(F.broadcast(offsets), task == F.col("task")).select(*sources.columns, weight.alias("weight"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, ...) with ``weight`` and ``target``."""
    ranked = pin(_ranked(sources, weights), "weights")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    sums = (F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)))
    total, weight = ranked.agg(*sums).first()
    words, open_weight, known = total, weight, -1
    while True:
        # wanted at the present level: weight * words / open_weight
        over = most * wide("source_size") * F.lit(open_weight).cast("decimal(18,0)") <= wide("weight") * F.lit(words).cast("decimal(18,0)")
        count, held, gone = ranked.where(over).agg(F.count("*"), *sums).first()
        if count == known:
            break
        words, open_weight, known = total - most * held, weight - gone, count
    level = words / open_weight if open_weight else 0.0
    target = F.when(over, F.col("source_size") * float(most)).otherwise(F.col("weight") * F.lit(float(level)))
    return ranked.withColumn("target", target)


def _draw(a: Column, b: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _whole(x: Column) -> Column:
    return F.when(x < _NEAR, 0.0).when(x > 1 - _NEAR, 1.0).otherwise(x)


def _exchange(state: Column, item: Column, seed: int) -> Column:
    """One meeting: the state's document and the next one exchange words until one of them is settled."""
    own = state["rest"]
    gain = F.least((1 - own["x"]) * own["size"], item["x"] * item["size"])
    loss = F.least(own["x"] * own["size"], (1 - item["x"]) * item["size"])
    gains = _draw(own["draw"], item["draw"], seed) * (gain + loss) < loss
    moved = F.when(gains, gain).otherwise(-loss)
    mine = own.withField("x", _whole(own["x"] + moved / own["size"]))
    other = item.withField("x", _whole(item["x"] - moved / item["size"]))
    settled = (mine["x"] == 0) | (mine["x"] == 1)
    return F.struct(
        F.when(settled, other).otherwise(mine).alias("rest"),
        F.concat(state["done"], F.array(F.when(settled, mine).otherwise(other))).alias("done"),
    )


def _rounded(items: DataFrame, seed: int, chunk: int) -> DataFrame:
    """(..., item) with the settled ``x`` of every item; ``items`` has source, source_size, target, copies,
    n_chunks and item. A level of the tree leaves one unsettled item per chunk."""
    keys, settled = ["source", "source_size", "target", "copies", "n_chunks"], None
    kind = items.schema["item"].dataType.simpleString()
    level = 0
    while True:
        most = items.agg(F.max("n_chunks")).first()[0]
        if most is None:
            return items if settled is None else settled
        nth = F.pmod(F.xxhash64(F.lit(seed + level), F.col("item.draw")), F.col("n_chunks")).alias("nth")
        met = items.groupBy(*keys, nth).agg(F.array_sort(F.collect_list("item")).alias("met"))
        start = F.struct(F.get("met", F.lit(0)).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))
        others = F.slice("met", F.lit(2), F.size("met"))
        ended = F.aggregate(others, start, lambda s, item: _exchange(s, item, seed + level))
        met = pin(met.select(*keys, ended.alias("ended")).select(*keys, "ended.done", "ended.rest"), "rounded")
        done = met.select(*keys, F.explode("done").alias("item"))
        settled = done if settled is None else settled.unionByName(done)
        rest = met.select(*keys, F.col("rest").alias("item"))
        if most == 1:
            return settled.unionByName(rest)
        is_whole = F.col("item.x").isin(0.0, 1.0)
        settled = settled.unionByName(rest.where(is_whole))
        items = rest.where(~is_whole).withColumn("n_chunks", F.ceil(F.col("n_chunks") / chunk))
        level += 1


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 11,
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document: ``copies`` is how often
    the document is wanted, ``taken`` how many of its words the mix takes, repeats counted."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(F.col(f"`{text}`").cast("string")).alias("size"),
    )
    groups = pin(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    size = F.sum(F.col("size") * F.col("rows")).alias("source_size")
    sources = targets(pin(groups.groupBy("source").agg(size, F.count("*").alias("n_items")), "sources"), weights, most)
    count, names = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    sources = F.broadcast(sources) if names + 64 * count <= BROADCAST else sources

    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = groups.alias("g").join(sources.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")))
    wanted = wanted.select("g.*", "source_size", "target", "n_items", copies.alias("copies"))
    part = F.col("copies") - F.floor("copies")
    up = F.floor(F.col("rows") * part + _NEAR).cast("long")
    left = F.greatest(F.col("rows") * part - up, F.lit(0.0))
    item = F.struct(
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("draw"), "doc_id", F.col("size"), "rows", up.alias("up"),
        F.when(F.col("size") > 0, _whole(left)).otherwise(0.0).alias("x"),
    )
    n_chunks = F.ceil(F.col("n_items") / chunk).alias("n_chunks")
    items = pin(wanted.select("source", "source_size", "target", "copies", n_chunks, item.alias("item")), "fractions")
    open_ = F.col("item.x") > 0
    settled = items.where(~open_).unionByName(_rounded(items.where(open_), seed, chunk))

    flat = settled.select("item.doc_id", "source", "item.size", "source_size", "target", "copies", "item.rows", "item.up", "item.x")
    few = flat.where(F.col("rows") <= ROWS).withColumn("first", F.lit(0).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(ROWS).cast("long"))
    many = flat.where(F.col("rows") > ROWS).withColumn("first", F.explode(blocks))
    many = many.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "size", "first")
    out = few.unionByName(many)
    last = F.least(F.col("first") + ROWS, F.col("rows")) - 1
    out = out.withColumn("nth", F.explode(F.sequence("first", last)))
    full = F.floor("copies").cast("long") * F.col("size")
    more = F.when(F.col("nth") < F.col("up"), F.col("size")).when(F.col("nth") == F.col("up"), F.round(F.col("x") * F.col("size")).cast("long"))
    taken = full + F.coalesce(more, F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", taken.alias("taken"))
