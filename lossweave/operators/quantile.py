"""Exact interpolated quantiles by radix selection, which never hold a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossweave.functions.values import order_bits
from lossweave.runtime import write_once

#: Bits that are known after each round: a histogram has at most 2 ** 16 counts per group and wanted rank.
_SHIFTS = (48, 32, 16, 0)


def exact_quantile(rows: DataFrame, keys: list[str], value: Column, q: float, name: str) -> DataFrame:
    """The q-quantile of ``value`` per key with linear interpolation, as one row per key.

    The bits of a number, read as a long that sorts like it, are fixed 16 at a time from the top. A round counts
    the rows of each group by their next 16 bits, among those that share the bits known so far, and takes the
    count that holds the wanted rank; after four rounds one number is left. Four passes over (key, number)
    whatever the numbers are: only counts are shuffled, and heavy tails, ties and infinities change nothing.
    Rows without a value, and rows with a null key, do not count. NaN is the largest number.
    """
    held = [f"k{i}" for i in range(len(keys) or 1)]
    named = [F.col(f"`{k}`").alias(h) for k, h in zip(keys, held)] if keys else [F.lit(0).alias("k0")]
    data = rows.select(*named, value.cast("double").alias("v")).dropna()
    data = write_once(data.select(*held, "v", order_bits(F.col("v")).alias("bits")), "quantile-values")

    rank = (F.col("n") - 1) * F.lit(float(q))
    ends = F.array(*[F.struct(F.lit(e).alias("end"), f(rank).cast("long").alias("left")) for e, f in ((0, F.floor), (1, F.ceil))])
    wanted = data.groupBy(*held).agg(F.count("*").alias("n")).select(*held, "n", rank.alias("rank"), F.inline(ends))
    known: list[str] = []
    for shift in _SHIFTS:
        rest = data.withColumn("next", F.shiftright("bits", shift))
        if known:
            rest = rest.withColumn("prefix", F.shiftright("bits", shift + 16))
            rest = rest.join(wanted.select(*held, "prefix").distinct(), [*held, "prefix"], "left_semi")
        counts = rest.groupBy(*held, *known, "next").agg(F.count("*").alias("c"), F.min("v").alias("v"))
        upto = F.sum("c").over(Window.partitionBy(*held, "end").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        placed = wanted.join(counts, [*held, *known]).withColumn("upto", upto)
        placed = placed.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("c") <= F.col("left")))
        left = (F.col("left") - (F.col("upto") - F.col("c"))).alias("left")
        wanted = placed.select(*held, "n", "rank", "end", left, F.col("next").alias("prefix"), "v")
        known = ["prefix"]
        if shift:
            wanted = wanted.drop("v")
    pair = wanted.groupBy(*held, "rank").agg(*[F.min(F.when(F.col("end") == e, F.col("v"))).alias(c) for e, c in ((0, "a"), (1, "z"))])
    between = F.col("a") + (F.col("z") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    found = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(between).alias(name)
    return pair.select(*[F.col(h).alias(k) for h, k in zip(held, keys)], found)
