"""Toxic passages by maximum-scoring segments.

Training: labelled documents outside the held-out fold (a bounded sample of each class, taken by the order of
a hash). A token is a lower-cased run of letters and digits; it counts as itself and by its first bytes, so
that unseen forms of a known beginning are still scored. For each token the log-odds of standing in a toxic
against a clean document are taken with an informative Dirichlet prior (the token's overall share), and kept
if they lie beyond ``least_z`` standard errors.

Scan: each token scores its log-odds less a small drift, so the sum falls on clean text. All maximal scoring
segments are found in one pass over the positive tokens (every segment ends where its sum is largest and
overlaps no other; the scan links each open segment to the last one that starts lower, which makes it linear).
Segments are calibrated by extreme-value statistics: the largest score of a clean text of n tokens exceeds x
with probability 1 - exp(-K n exp(-lambda x)). A document's score is a logistic function of its largest
segment's calibrated score. Lambda, K and that function, in which both classes weigh the same, are fitted to
scores that each part of the sample gets from a model of the other parts, so they hold for unseen texts.

Defined results: null text is empty text and gets the score of a text without segments; documents without an
id or a label are scored like all others; a document with several labels counts as toxic if one of them says
so; without training documents of both classes every score is the share of toxic ones (0 if there are none);
repeated rows give repeated results; an empty table gives an empty result. The labels table may be empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lossweave.llm.arrays import BLOCK, U64, mix, pieces, text_bytes, word_bounds, word_hashes

BEGINNING = 6  # bytes
PARTS = 4  # of the sample; each is scored by a model of the others
_COUNTS = [f"{kind}_{k}" for k in range(PARTS) for kind in ("clean", "toxic")]
_LETTER = np.array([i >= 0x80 or chr(i).isalnum() for i in range(256)])
_BY_BEGINNING = U64(0xA5A5F00D5EED1234)


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # sorted hashes of tokens and beginnings
    scores: np.ndarray
    drift: float
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, float] = (0.0, 0.0)  # of the logistic decision over the largest segment


def fold(key: Column, parts: int) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % parts


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and hashes of beginnings of all tokens, and per row the index of its first."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends, first = word_bounds(data, offsets, ~_LETTER)
    whole = word_hashes(data, starts, ends)
    head = mix(word_hashes(data, starts, np.minimum(ends, starts + BEGINNING)) ^ _BY_BEGINNING)
    return starts - offsets[np.repeat(np.arange(len(offsets) - 1), np.diff(first))], ends - starts, whole, head, first


def segments_of(places: np.ndarray, values: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time. ``places`` and ``values`` are the scored tokens; any token
    between them scores ``-drift``. Returns first token, last token and score of each."""
    done: list[list] = []
    stack: list[list] = []  # first, last, sum before, sum after, index of the last one below with a lower sum before
    total, seen = 0.0, -1
    for place, value in zip(places.tolist(), values.tolist()):
        total -= drift * (place - seen - 1)
        seen = place
        if value <= 0:
            total += value
            continue
        new = [place, place, total, total + value, -1]
        total += value
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]
            if k < 0:  # no later sum comes below what is settled here: those segments are final
                done += stack
                stack = [new]
                break
            if stack[k][3] >= new[3]:
                new[4] = k
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3], -1]
            k, below = stack[k][4], k
            del stack[below:]
    return [(a, b, high - low) for a, b, low, high, _ in done + stack]


def scan(column: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Per text: its number of tokens, and its segments as (start byte, stop byte, score)."""
    starts, sizes, whole, head, first = tokens_of(column)
    value = np.full(len(whole), -model.drift)
    if len(model.tokens):
        for hashes in (head, whole):  # a token of its own outweighs its beginning
            at = np.minimum(np.searchsorted(model.tokens, hashes), len(model.tokens) - 1)
            known = model.tokens[at] == hashes
            value[known] = model.scores[at[known]] - model.drift
    hit = np.flatnonzero(value != -model.drift)
    bounds = np.searchsorted(hit, first)
    for k in range(len(column)):
        own = hit[bounds[k] : bounds[k + 1]]
        found = segments_of(own - first[k], value[own], model.drift) if len(own) else []
        spans = [(int(starts[first[k] + a]), int(starts[first[k] + b] + sizes[first[k] + b]), s) for a, b, s in found]
        yield int(first[k + 1] - first[k]), spans


def calibrated(count: int, scores: np.ndarray, model: Model) -> np.ndarray:
    """Scores less what chance gives in a text of this length: about ln(1 / E) for expected number E. In texts so
    short that chance gives less than one segment, segments are judged as in those where it gives one."""
    return model.rate * scores - np.log(max(model.scale * count, 1.0))


def largest(count: int, scores: np.ndarray, model: Model) -> float:
    """The calibrated score of a text's largest segment; a text without segments has one of score 0."""
    return float(calibrated(count, np.array([scores.max(initial=0.0)]), model)[0])


def _sample(labels: DataFrame, limit: int) -> DataFrame:
    """A bounded sample of labelled ids outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(fold(F.col("id"), 5) != 0).groupBy("id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    by_hash = [F.xxhash64("id"), "id"]
    return known.where("toxic = 1").orderBy(*by_hash).limit(limit).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(2 * limit))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic documents of each part of the sample each token of the task stands."""
    counts: dict[int, list[int]] = {}
    for batch in batches:
        for piece in pieces(batch, "text", BLOCK):
            _, _, whole, head, first = tokens_of(piece.column("text"))
            for k, group in enumerate(piece.column("group").to_pylist()):
                for token in np.unique(np.concatenate([x[first[k] : first[k + 1]] for x in (whole, head)])).tolist():
                    counts.setdefault(token, [0] * (2 * PARTS))[group] += 1
    table = np.array([(k, *v) for k, v in counts.items()], np.uint64).reshape(-1, 1 + 2 * PARTS).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T.copy()], names=["token", *_COUNTS])


def _strength(clean: Column, toxic: Column, totals: tuple[int, int], prior: float) -> Column:
    """Standard errors between a token's log-odds in toxic and in clean documents."""
    share = prior * (clean + toxic) / max(1, sum(totals))
    odds = lambda x, n: F.log(x / (n + prior - x))
    return F.abs(odds(toxic + share, totals[1]) - odds(clean + share, totals[0])) / F.sqrt(1 / (toxic + share) + 1 / (clean + share))


def _log_odds(token: np.ndarray, clean: np.ndarray, toxic: np.ndarray, totals: tuple[int, int], prior: float, least_z: float):
    some = clean + toxic > 0
    token, clean, toxic = token[some], clean[some], toxic[some]
    share = (clean + toxic) / max(1, sum(totals))
    a_toxic, a_clean = toxic + prior * share, clean + prior * share
    odds = lambda x, n: np.log(x / (n + prior - x))
    delta = odds(a_toxic, totals[1]) - odds(a_clean, totals[0])
    strong = np.abs(delta) / np.sqrt(1 / a_toxic + 1 / a_clean) >= least_z
    keys = token.view(np.uint64)[strong]
    order = np.argsort(keys)
    return keys[order], delta[strong][order]


def _extremes(rows: np.ndarray) -> tuple[float, float]:
    """(lambda, K) from clean texts' (number of tokens, largest score)."""
    count, top = np.maximum(rows[:, 0], 1), rows[:, 1]
    rate, some = 1.0, top[top > 0]
    if len(some) >= 10:
        tail = some[some >= np.median(some)]
        rate = float(np.clip(1 / max(1e-6, (tail - tail.min()).mean()), 0.1, 3.0))
    # K n exp(-lambda M) is exponential with mean 1 for the largest score M of a clean text
    return rate, 1 / max(1e-9, float(np.mean(count * np.exp(-rate * top))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope; both classes weigh the same in all."""
    weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(2), ridge * np.diag([1e-6, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * (p * (1 - p) + 1e-9))[:, None]) + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = 6_000, prior: float = 50.0, least_z: float = 2.5, drift: float = 0.3) -> Model:
    """Fit on at most ``limit`` toxic and ``2 * limit`` clean documents. All their tokens are weighed. Calibration
    and decision are fitted on scores from models that did not see the document's part of the sample."""
    part = F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(PARTS))
    sample = _sample(labels, limit).withColumn("group", (2 * part + F.col("toxic")).cast("int"))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    # bounded: 3 * limit ids
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), body).join(F.broadcast(sample), "id").select("text", "toxic", "group")
    sizes = np.zeros(2 * PARTS, np.int64)
    for r in chosen.groupBy("group").count().collect():
        sizes[r.group] = r["count"]
    clean, toxic = int(sizes[::2].sum()), int(sizes[1::2].sum())
    if not clean or not toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), drift, weights=(30.0 if toxic else -30.0, 0.0))
    counts = chosen.mapInArrow(_presence, "token long, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    sides = [[k for k in range(PARTS) if k != out] for out in (*range(PARTS), None)]
    totals = [tuple(int(sizes[[2 * k + t for k in side]].sum()) for t in (0, 1)) for side in sides]
    of = lambda side, t: sum(F.col(_COUNTS[2 * k + t]) for k in side)
    strong = [(of(s, 0) + of(s, 1) > 0) & (_strength(of(s, 0), of(s, 1), n, prior) >= least_z) for s, n in zip(sides, totals)]
    # only tokens that are strong for one of the models come to the driver
    rows = counts.where(functools.reduce(lambda a, b: a | b, strong)).toArrow()
    token, table = rows.column(0).to_numpy(), np.array([c.to_numpy() for c in rows.columns[1:]])
    models = []
    for side, total in zip(sides, totals):
        own = [table[[2 * k + t for k in side]].sum(axis=0) for t in (0, 1)]
        models.append(Model(*_log_odds(token, *own, total, prior, least_z), drift))
    scanned = chosen.mapInArrow(_scores(models[:-1]), "toxic int, count long, top double").toArrow()
    seen = np.column_stack([scanned.column(c).to_numpy().astype(float) for c in ("count", "top")])
    toxic_rows = scanned.column("toxic").to_numpy() > 0
    rate, scale = _extremes(seen[~toxic_rows])
    whole = Model(models[-1].tokens, models[-1].scores, drift, rate, scale)
    x = np.array([largest(int(n), np.array([top]), whole) for n, top in seen])
    weights = _logistic(x, toxic_rows.astype(float))
    return Model(whole.tokens, whole.scores, drift, rate, scale, weights if weights[1] > 0 else (-30.0, 0.0))


def _scores(models: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("group").to_numpy() // 2
            for part in np.unique(parts).tolist():
                rows = batch.filter(pa.array(parts == part))
                for piece in pieces(rows, "text", BLOCK):
                    found = [(n, max((s for *_, s in spans), default=0.0)) for n, spans in scan(piece.column("text"), models[part])]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("toxic").cast(pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.float64())))],
                        names=["toxic", "count", "top"],
                    )

    return run


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted, passages): the score is the logistic value of the largest segment, and
    ``passages`` are all segments that reach 0.5 on their own, in bytes of the lower-cased text: a document is
    predicted toxic if and only if it has one. With ``keep`` the struct column ``row`` holds all columns of the
    document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def logit(count: int, scores: np.ndarray) -> np.ndarray:
        return model.weights[0] + model.weights[1] * calibrated(count, scores, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", BLOCK):
                values, passages = [], []
                for count, spans in scan(piece.column("text"), model):
                    z = logit(count, np.array([0.0, *(s for _, _, s in spans)]))
                    values.append(1 / (1 + np.exp(-np.clip(z.max(), -30, 30))))
                    passages.append([{"start": i, "stop": j, "score": s} for (i, j, s), own in zip(spans, z[1:]) if own >= 0])
                kept = [piece.column("row")] if keep else []
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(values, pa.float64()), pa.array(passages, kind), *kept],
                    names=["doc_id", "score", "passages", "row"][: 3 + keep],
                )

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body, *row)
    passage = T.StructType().add("start", "long").add("stop", "long").add("score", "double")
    schema = T.StructType().add("doc_id", "long").add("score", "double").add("passages", T.ArrayType(passage))
    if keep:
        schema = schema.add("row", source.schema["row"].dataType)
    scored = source.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
