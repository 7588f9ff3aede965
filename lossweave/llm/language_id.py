"""Language of documents by a bidirectional gated recurrent network over bytes.

A sequence is a run of letters (lower-cased UTF-8 bytes; longer runs go in stretches of ``STRETCH`` bytes).
Two gated recurrent layers read it in both directions; at every byte a softmax over their joined states
labels the position. A document's probabilities are the mean over all its positions. Since the state starts
anew with every run, equal runs have equal labels, so each distinct run of a task goes through the network
once, whatever its count; all bytes of whole texts take part.

Training (numpy, backpropagation through time, Adam): labelled documents of the training folds, of which a
bounded sample per language is taken by the order of a hash; from its distinct runs a bounded number per
language is drawn by the order of a hash, weighted by the logarithm of their count.

Defined results: a text that is null or has no letter is ``und`` with score 0; without a training document
every text is ``und``; repeated rows give repeated results; null ids are kept and never learned from; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.arrays import pieces, text_bytes, word_bounds, word_hashes
from lossweave.llm.toxicity import fold

STRETCH = 24
_LETTER = np.array([i >= 0x80 or chr(i).isalpha() for i in range(256)])
_KNOWN_RUNS = 400_000


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(languages: list[str], hidden: int, seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)
    weights = {}
    for way in "fb":
        weights[f"x{way}"] = draw.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        weights[f"u{way}"] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
    weights["o"] = draw.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
    weights["c"] = np.zeros(len(languages), np.float32)
    return Network(languages, weights)


def _layer(x: np.ndarray, u: np.ndarray, mask: np.ndarray, steps: range):
    """States of one direction. ``x`` (time, rows, 3 h) are the inputs' shares of update, reset and candidate."""
    hidden = u.shape[0]
    state = np.zeros((x.shape[1], hidden), np.float32)
    out, kept = np.zeros((*x.shape[:2], hidden), np.float32), {}
    for t in steps:
        share = state @ u
        gates = _sigmoid(x[t, :, : 2 * hidden] + share[:, : 2 * hidden])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        candidate = np.tanh(x[t, :, 2 * hidden :] + reset * share[:, 2 * hidden :])
        kept[t] = (state, share, update, reset, candidate)
        fresh = (1 - update) * candidate + update * state
        state = np.where(mask[t, :, None], fresh, state)
        out[t] = state
    return out, kept


def _layer_back(gradient: np.ndarray, kept: dict, u: np.ndarray, mask: np.ndarray, steps: range):
    """Gradients of a direction's inputs and recurrent weights, back through time."""
    hidden = u.shape[0]
    d_x = np.zeros((*gradient.shape[:2], 3 * hidden), np.float32)
    d_u = np.zeros_like(u)
    d_state = np.zeros(gradient.shape[1:], np.float32)
    for t in reversed(steps):
        state, share, update, reset, candidate = kept[t]
        live = mask[t, :, None]
        d = gradient[t] + d_state
        d_fresh = np.where(live, d, 0)
        d_candidate = d_fresh * (1 - update) * (1 - candidate**2)
        d_update = d_fresh * (state - candidate) * update * (1 - update)
        d_reset = d_candidate * share[:, 2 * hidden :] * reset * (1 - reset)
        d_x[t] = np.concatenate([d_update, d_reset, d_candidate], 1)
        d_share = np.concatenate([d_update, d_reset, d_candidate * reset], 1)
        d_u += state.T @ d_share
        d_state = d_share @ u.T + d_fresh * update + np.where(live, 0, d)
    return d_x, d_u


def _forward(network: Network, codes: np.ndarray, sizes: np.ndarray):
    """Log-probabilities (time, rows, languages) of padded byte sequences (rows, time)."""
    w = network.weights
    codes = codes.T
    mask = np.arange(len(codes))[:, None] < sizes
    ahead, back = range(len(codes)), range(len(codes) - 1, -1, -1)
    forward, kept_f = _layer(w["xf"][codes], w["uf"], mask, ahead)
    backward, kept_b = _layer(w["xb"][codes], w["ub"], mask, back)
    states = np.concatenate([forward, backward], 2)
    logits = states @ w["o"] + w["c"]
    logits -= logits.max(axis=2, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), (mask, states, kept_f, kept_b, ahead, back, codes)


def gradients(network: Network, codes: np.ndarray, sizes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (mean over the weighted positions) and its gradients."""
    w = network.weights
    logp, (mask, states, kept_f, kept_b, ahead, back, codes_t) = _forward(network, codes, sizes)
    share = mask * (weight / sizes)
    share = (share / share.sum()).astype(np.float32)
    rows = np.arange(len(sizes))
    loss = -float((logp[:, rows, target] * share).sum())
    d_logits = np.exp(logp)
    d_logits[:, rows, target] -= 1
    d_logits *= share[:, :, None]
    hidden = w["uf"].shape[0]
    flat = d_logits.reshape(-1, d_logits.shape[2])
    out = {"o": states.reshape(-1, 2 * hidden).T @ flat, "c": flat.sum(0)}
    d_states = d_logits @ w["o"].T
    for way, part, kept, steps in (("f", d_states[..., :hidden], kept_f, ahead), ("b", d_states[..., hidden:], kept_b, back)):
        d_x, out[f"u{way}"] = _layer_back(part, kept, w[f"u{way}"], mask, steps)
        d_table = np.zeros_like(w[f"x{way}"])
        np.add.at(d_table, codes_t[mask], d_x[mask])
        out[f"x{way}"] = d_table
    return loss, out


def train(network: Network, runs: list[bytes], target: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 512, rate: float = 0.01) -> Network:
    draw = np.random.default_rng(11)
    codes, sizes = _padded(runs)
    w = network.weights
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(runs))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            width = int(sizes[pick].max())
            _, g = gradients(network, codes[pick, :width], sizes[pick], target[pick], weight[pick])
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                w[k] -= (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return network


def _padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in runs], np.int64)
    codes = np.zeros((len(runs), int(sizes.max(initial=1))), np.uint8)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
    return codes, sizes


def label_runs(network: Network, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run the sums over its positions of every language's probability. All positions are labelled; long
    runs go in stretches."""
    parts = -(-sizes // STRETCH)
    which = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[which] + nth * STRETCH
    length = np.minimum(sizes[which] - nth * STRETCH, STRETCH)
    out = np.zeros((len(starts), len(network.languages)))
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), 4096):
        pick = order[at : at + 4096]
        width = int(length[pick].max())
        place = begin[pick, None] + np.arange(width)
        codes = data[np.minimum(place, len(data) - 1)]
        logp, (mask, *_) = _forward(network, codes, length[pick])
        np.add.at(out, which[pick], (np.exp(logp) * mask[:, :, None]).sum(0))
    return out


def runs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends of the runs of letters, and per row the index of its first run."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends, first = word_bounds(data, offsets, ~_LETTER)
    return data, starts, ends, first


def _counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, bytes], int] = {}
        for piece in pieces(batch, "text"):
            data, starts, ends, first = runs_of(piece.column("text"))
            raw = data.tobytes()
            for k, lang in enumerate(piece.column("lang").to_pylist()):
                for i in range(first[k], first[k + 1]):
                    for a in range(starts[i], ends[i], STRETCH):
                        key = (lang, raw[a : min(a + STRETCH, ends[i])])
                        counts[key] = counts.get(key, 0) + 1
        if counts:
            langs, runs = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(runs, pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "run", "times"],
            )


def fit(docs: DataFrame, hidden: int = 16, documents_per_language: int = 300, runs_per_language: int = 6_000, most_languages: int = 200) -> Network | None:
    """Fit on at most so many training documents of each language (in the order of a hash) and so many of their
    distinct runs; the ``most_languages`` most frequent languages are learned."""
    from pyspark.sql import Window

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), body)
    known = known.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id"), 4) != 2))
    names = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    names.sort()
    if not names:
        return None
    # row_number limits are applied in every task before the rows meet
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    known = known.where(F.col("lang").isin(names))
    chosen = known.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= documents_per_language)
    sample = known.join(F.broadcast(chosen.select("id").distinct()), "id").select("lang", "text")
    counted = sample.mapInArrow(_counted_runs, "lang string, run binary, times long").groupBy("lang", "run").agg(F.sum("times").alias("times"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("run"), "run")
    drawn = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= runs_per_language)
    rows = drawn.where(F.col("lang").isin(names)).orderBy("lang", "rank").collect()
    place = {lang: i for i, lang in enumerate(names)}
    target = np.array([place[r.lang] for r in rows], np.int64)
    if not len(rows):
        return None
    return train(initial(names, hidden), [bytes(r.run) for r in rows], target, np.log1p(np.array([r.times for r in rows], float)))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score, probabilities): ``probabilities`` are the pooled ones, in the order of the
    network's languages."""
    languages = network.languages if network else []

    def pooled(column: pa.Array, known: dict[str, np.ndarray]) -> np.ndarray:
        data, starts, ends, first = runs_of(column)
        keys = word_hashes(data, starts, ends)
        distinct, at, where = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(known["keys"], distinct), max(0, len(known["keys"]) - 1))
        found = known["keys"][place] == distinct if len(known["keys"]) else np.zeros(len(distinct), bool)
        table = np.zeros((len(distinct), len(languages)))
        table[found] = known["sums"][place[found]]
        new = ~found
        if new.any():
            table[new] = label_runs(network, data, starts[at[new]], (ends - starts)[at[new]])
            if len(known["keys"]) > _KNOWN_RUNS:
                known["keys"], known["sums"] = distinct, table
            else:
                merged = np.concatenate([known["keys"], distinct[new]])
                order = np.argsort(merged, kind="stable")
                known["keys"] = merged[order]
                known["sums"] = np.concatenate([known["sums"], table[new]])[order]
        sums = np.zeros((len(where) + 1, len(languages)))
        np.cumsum(table[where], axis=0, out=sums[1:])
        sizes = np.append(0, np.cumsum(ends - starts))
        total = sums[first[1:]] - sums[first[:-1]]
        return total / np.maximum(sizes[first[1:]] - sizes[first[:-1]], 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {"keys": np.zeros(0, np.uint64), "sums": np.zeros((0, len(languages)))}
        names = np.array([*languages, "und"], object)
        for batch in batches:
            for piece in pieces(batch, "text"):
                share = pooled(piece.column("text"), known) if languages else np.zeros((piece.num_rows, 0))
                letters = piece.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                best = share.argmax(axis=1) if languages else np.full(piece.num_rows, -1)
                best[~letters] = -1
                value = np.clip(np.where(best >= 0, share.max(axis=1, initial=0), 0), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(names[best], pa.string()), pa.array(value), pa.array(list(share), pa.list_(pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "probabilities"],
                )

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, probabilities array<double>")
