"""Claim sources: mapped column selection and reproducible samples of any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lossweave.schema import AMOUNT_FIELDS, DEFAULT_COLUMNS, ColumnMap


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def mapped_scan(source: DataFrame, columns: ColumnMap) -> DataFrame:
    """Only the mapped physical columns, under their own names, so that the scan reads nothing else."""
    columns.check()
    return source.select(*[_quoted(name) for name in columns.selected()])


def logical_claims(source: DataFrame, columns: ColumnMap, carried: tuple[str, ...] = ()) -> DataFrame:
    """One column per logical field, and the ``carried`` ones; skipped fields are typed nulls."""
    columns.check()
    mapped = columns.mapped()
    return source.select(
        *[
            _quoted(mapped[name]).alias(name)
            if name in mapped
            else F.lit(None).cast(T.DoubleType() if name in AMOUNT_FIELDS else T.StringType()).alias(name)
            for name in DEFAULT_COLUMNS
        ],
        *map(_quoted, carried),
    )


# Rows at the edge of a sample that one task may order.
EDGE_ROWS = 100_000
_DIGITS = 4


def sample_rows(source: DataFrame, row_limit: int | None, key: str = "claim_id", seed: int = 42) -> DataFrame:
    """A fixed number of rows chosen by a seeded hash of the key; the same input gives the same sample.

    Rows whose hash begins below a cut are kept in place; of those that share the cut's beginning, only as
    many as are missing are picked in order. The beginning gets longer until few rows share it (rows with equal keys
    share the whole hash, and stop at its end).
    """
    if row_limit is None:
        return source
    if row_limit <= 0:
        raise ValueError("a sample takes a positive number of rows")
    order = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)
    known, missing = "", row_limit
    while True:
        width = len(known) + _DIGITS
        beginning = F.substring(order, 1, width)
        edge = source.where(F.startswith(order, F.lit(known))) if known else source
        counts = edge.groupBy(beginning.alias("beginning")).agg(F.count("*").alias("n"))
        # at most 16 ** _DIGITS rows
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("beginning")))
        cut = upto.where(F.col("upto") >= missing).orderBy("beginning").first()
        if cut is None:
            return source
        known, missing = cut["beginning"], missing - cut["upto"] + cut["n"]
        if cut["n"] <= EDGE_ROWS or width >= 64:
            break
    below = source.where(F.substring(order, 1, len(known)) < known)
    at_edge = source.where(F.startswith(order, F.lit(known))).orderBy(order, F.col(key)).limit(missing)
    return below.unionByName(at_edge).orderBy(order, F.col(key))
