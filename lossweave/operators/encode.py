"""Text to unit vectors: a plug-in encoder inside the tasks, or lexical vectors as Spark ML makes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions.keywords import hashed_counts
from lossweave.functions.text import PASSAGE_PREFIX, with_prefix
from lossweave.functions.vectors import unit_rows

Encoder = Callable[[], Callable[[list[str]], np.ndarray]]
PASSAGE_BATCH = 64


def encode(
    rows: DataFrame, text: str, encoder: Encoder, prefix: str = PASSAGE_PREFIX, batch_size: int = PASSAGE_BATCH
) -> DataFrame:
    """Add ``embedding`` (unit float vectors). The factory is called once per task, in the task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            vectors = []
            for start in range(0, len(batch), batch_size):
                chunk = np.asarray(model(batch.iloc[start : start + batch_size].tolist()), dtype=np.float64)
                vectors.extend(unit_rows(chunk).astype(np.float32))
            yield pd.Series(vectors, index=batch.index)

    # Spark may not repeat a call of unknown outcome, so the encoder runs once per row, whatever filters follow.
    embed = embed.asNondeterministic()
    return rows.withColumn("embedding", embed(with_prefix(F.coalesce(F.col(text), F.lit("")), prefix)))


def _tokens(rows: DataFrame, text: str) -> Column:
    """What tokens are counted in: a text, or the search tokens of the document in rows that hold them."""
    return F.col("search_tokens") if text == "document" and "search_tokens" in rows.columns else F.col(text).cast("string")


@dataclass(frozen=True)
class LexicalEncoder:
    weights: np.ndarray  # the inverse document frequency of each hash


def fit_lexical_encoder(corpus: DataFrame, text: str = "document", dimensions: int = 384) -> LexicalEncoder:
    """Hashed term counts, inverse document frequency and unit length: the vectors of ``HashingTF``, ``IDF`` and
    ``Normalizer``, from different tokens instead of single ones. Knows words only, not meaning. A task sends a row per hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            n += batch.num_rows
            for counts in hashed_counts(batch.column(0), dimensions):
                held += (counts > 0).sum(axis=0)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], n))], names=["slot", "n"])

    found = corpus.select(_tokens(corpus, text).alias("tokens")).mapInArrow(count, "slot long, n long")
    n_held = dict(found.groupBy("slot").agg(F.sum("n")).collect())  # a row per hash
    n = n_held.pop(-1, 0)
    if not n:
        raise ValueError("An encoder needs rows to learn from; there are none.")
    held = np.zeros(dimensions)
    held[list(n_held)] = list(n_held.values())
    return LexicalEncoder(np.log((n + 1.0) / (held + 1.0)))


def lexical_encode(rows: DataFrame, model: LexicalEncoder, text: str = "document") -> DataFrame:
    """Add ``embedding`` (unit float vectors; zero without a known word)."""
    weights = model.weights

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            vectors = [np.zeros((0, len(weights)), np.float32)]
            for counts in hashed_counts(tokens, len(weights)):
                weighted = counts * weights
                # summed one after the other, as Spark ML does
                norms = np.sqrt(np.cumsum(weighted**2, axis=1)[:, -1:])
                vectors.append((weighted / np.where(norms > 0, norms, 1.0)).astype(np.float32))
            lines = np.concatenate(vectors)
            offsets = np.arange(len(lines) + 1, dtype=np.int32) * len(weights)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines.ravel()))

    # Spark may not repeat a call of unknown outcome, so vectors are made once per row, whatever filters follow.
    return rows.withColumn("embedding", embed.asNondeterministic()(_tokens(rows, text)))
