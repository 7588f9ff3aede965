"""Session helpers: shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
_PINNED: weakref.WeakSet[DataFrame] = weakref.WeakSet()

PIN_ROWS = 20_000
PIN_BYTES = 8 * 1024 * 1024


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the folder every executor can reach (``spark.checkpoint.dir``).

    Only a local session may fall back to a temporary folder, which it then also
    sets as its checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
        root = tempfile.mkdtemp(prefix="lossweave-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that whatever uses it several times computes it
    once and a lost executor costs no recomputation of what lies before it."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame):
    """Rough width of a row: text by its length, the elements of arrays by eight bytes each."""
    widths = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            widths.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            widths.append(F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 8)
        else:
            widths.append(F.lit(8))
    return sum(widths, F.lit(16)).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a frame that should be small. ``take`` reads a large one only until it has too many rows."""
    widths = df.select(_row_bytes(df)).take(rows + 1)
    return len(widths) <= rows and sum(w[0] for w in widths) <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a side whose measured size allows it; else leave the join to Catalyst and AQE."""
    pinned, small = pin_small(df)
    if small:
        return F.broadcast(pinned)
    return F.broadcast(df) if is_small(df) else df


def pin_small(df: DataFrame, rows: int = PIN_ROWS, size: int = PIN_BYTES) -> tuple[DataFrame, bool]:
    """Evaluate a small input (a batch of queries) once and hold its measured rows as a local
    table. A large input stays as it is. Also tells which of the two happened.
    """
    if df in _PINNED:
        return df, True
    owned = not df.is_cached
    if owned:
        df.persist()
    try:
        if not is_small(df, rows, size):
            return df, False
        pinned = df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    finally:
        if owned:
            df.unpersist()
    _PINNED.add(pinned)
    return pinned, True


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than there are cores.

    Meant for plain scans of small inputs ahead of text processing; a large table has more
    splits than cores and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
