"""Arrow batch kernels of the stored keyword index: claims dealt into slots, the slots' headers, and scores of slots."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from lossweave.functions import keywords as kx, vectors as vx

# The kernels travel with the tasks that use them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ("terms", "counts", "max_tfs", "min_dls", "claims", "tfs")
HEADER = FIELDS[:4]
# Slots that are made at a time, and the bytes of counts at which a slot ends early.
_SLOTS_AT_ONCE, _SLOT_BYTES = 16, 16 << 20
# Bytes of index rows that a task holds at a time.
_HOLD = 12 << 20
# Share of (slot, query) pairs below which slots are scored pair by pair.
_FEW = 0.05
_HELD = pa.struct([("claim_id", pa.string()), ("tf", pa.int64()), ("dl", pa.int32())])


def buckets_of(terms: pa.Array, buckets: int) -> np.ndarray:
    return kx._murmur3(terms).astype(np.int64) % buckets


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _whole(batches: Iterable[pa.RecordBatch], slot_claims: int) -> Iterator[pa.Table]:
    """Counts of claims in whole slots; a slot of very long texts ends early."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = sum(b.num_rows for b in held)
        if rows >= slot_claims * _SLOTS_AT_ONCE or sum(b.nbytes for b in held) >= _SLOT_BYTES:
            table, full = pa.Table.from_batches(held), max(1, rows // slot_claims) * slot_claims
            for at in range(0, full, slot_claims * _SLOTS_AT_ONCE):
                yield table.slice(at, min(slot_claims * _SLOTS_AT_ONCE, full - at, table.num_rows - at))
            held = table.slice(full).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def deal_batches(batches: Iterable[pa.RecordBatch], slot_claims: int, buckets: int, task: int) -> Iterator[pa.RecordBatch]:
    """A row per slot of successive claims (claim_id, dl, terms, tfs, dls): ids and lengths of its claims, and for each bucket
    of terms their headers (number of postings, greatest count, least length) and postings (place of the claim, count).
    A claim whose id has texts of different lengths has a place for each length."""
    number = task << 32
    for table in _whole(batches, slot_claims):
        claims = kx.Claims.of(table)
        size = len(claims.ids)
        plain = table.combine_chunks().column("dls").chunk(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == 0
        lengths = table.column("dl").to_numpy().astype(np.int64)
        held = np.unique(np.stack([claims.row, claims.dl.astype(np.int64)])[:, ~plain[claims.row]], axis=1) if not plain.all() else np.zeros((2, 0), np.int64)
        places = np.concatenate([np.stack([np.flatnonzero(plain), lengths[plain]]), held], axis=1)
        places = places[:, np.lexsort(places[::-1])]
        width = int(places[1].max(initial=0)) + 1
        place = np.searchsorted(places[0] * width + places[1], claims.row * width + claims.dl.astype(np.int64))
        n_slots = -(-size // slot_claims)
        first = np.searchsorted(places[0], np.arange(n_slots + 1) * slot_claims)
        slot = claims.row // slot_claims
        of_name = buckets_of(claims.names, buckets) if len(claims.names) else np.zeros(0, np.int64)
        order = np.lexsort((place, claims.term, of_name[claims.term], slot))
        slot, term, place = slot[order], claims.term[order], place[order]
        tf, dl = claims.tf[order].astype(np.int64), claims.dl[order].astype(np.int64)
        bucket = of_name[term]
        begins = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (term[1:] != term[:-1]))) if len(order) else order
        counts = np.diff(np.append(begins, len(order)))
        most, least = (np.maximum.reduceat(tf, begins), np.minimum.reduceat(dl, begins)) if len(order) else (tf, dl)
        columns = [pa.array(number + np.arange(n_slots)), _lists(first, claims.ids.cast(pa.string()).take(pa.array(places[0]))), _lists(first, _ints(places[1]))]
        local = place - first[slot]
        for k in range(buckets):
            head, post = np.flatnonzero(bucket[begins] == k), np.flatnonzero(bucket == k)
            heads = np.searchsorted(slot[begins[head]], np.arange(n_slots + 1))
            posts = np.searchsorted(slot[post], np.arange(n_slots + 1))
            names = claims.names.cast(pa.string()).take(pa.array(term[begins[head]]))
            fields = [_lists(heads, names), *(_lists(heads, _ints(v[head])) for v in (counts, most, least)), *(_lists(posts, _ints(v[post])) for v in (local, tf))]
            columns.append(pa.StructArray.from_arrays(fields, FIELDS))
        number += n_slots
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "ids", "dls", *(f"b{k}" for k in range(buckets))])


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _fields(table: pa.Table | pa.RecordBatch, k: int) -> dict[str, pa.Array]:
    column = _plain(table.column(f"b{k}"))
    return {column.type.field(i).name: v for i, v in enumerate(column.flatten())}


def block_batches(batches: Iterable[pa.RecordBatch], buckets: list[int], held: bool) -> Iterator[pa.RecordBatch]:
    """Index rows as blocks of one term and one slot: (term, slot, count, max_tf, min_dl, [held], bucket)."""
    for batch in batches:
        slots = batch.column("slot")
        for k in buckets:
            of = _fields(batch, k)
            which = np.repeat(np.arange(batch.num_rows), _sizes(of["terms"]))
            counts = _numbers(of["counts"])
            columns = [of["terms"].flatten(), slots.take(pa.array(which)), pa.array(counts), pa.array(_numbers(of["max_tfs"])), of["min_dls"].flatten()]
            if held:
                first = np.cumsum(_sizes(batch.column("ids"))) - _sizes(batch.column("ids"))
                place = pa.array(_numbers(of["claims"]) + np.repeat(first[which], counts))
                rows = [batch.column("ids").flatten().take(place), pa.array(_numbers(of["tfs"])), batch.column("dls").flatten().take(place)]
                rows = pa.StructArray.from_arrays([r.cast(f.type) for r, f in zip(rows, _HELD)], fields=list(_HELD))
                columns.append(_lists(np.append(0, np.cumsum(counts)), rows))
            names = ["term", "slot", "count", "max_tf", "min_dl", *(["held"] if held else []), "bucket"]
            yield pa.RecordBatch.from_arrays([*columns, _ints(np.full(len(which), k))], names=names)


class Slots:
    """Some index rows: their headers as claims that bound all claims of a slot, and, if read, their postings."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        table = table.combine_chunks()
        self.slots = _plain(table.column("slot")).to_numpy()
        parts = [_fields(table, k) for k in range(buckets)]
        words = pa.concat_arrays([of["terms"].flatten() for of in parts])
        names, term = kx._codes(words)
        slot = np.concatenate([np.repeat(np.arange(table.num_rows), _sizes(of["terms"])) for of in parts])
        joined = lambda field: np.concatenate([_numbers(of[field]) for of in parts])
        order = np.argsort(slot, kind="stable")
        self.headers = kx.Claims(pa.nulls(table.num_rows, pa.string()), names, slot[order], term[order], joined("max_tfs")[order], joined("min_dls")[order])
        if "ids" not in table.column_names:
            return
        ids, dls, sizes = _plain(table.column("ids")), _plain(table.column("dls")), _sizes(_plain(table.column("ids")))
        first = np.cumsum(sizes) - sizes
        counts = joined("counts")
        place = np.repeat(first[slot], counts) + joined("claims")
        # the places of one claim follow each other
        code, at = kx._codes(ids.flatten())[1], np.repeat(np.arange(len(sizes)), sizes)
        new = np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])) if len(code) else np.zeros(0, bool)
        claim = np.cumsum(new) - 1
        row, dl = claim[place], _numbers(dls)[place]
        order = np.argsort(row, kind="stable")
        self.claims = kx.Claims(ids.flatten().take(pa.array(np.flatnonzero(new))), names, row[order], np.repeat(term, counts)[order], joined("tfs")[order], dl[order])
        self.ends = np.append(0, np.cumsum(np.bincount(at[new], minlength=len(sizes))))
        self.longest = np.zeros(len(self.claims.ids), np.int64)
        np.maximum.at(self.longest, claim, _numbers(dls))

    def bounds(self, block: kx.QueryBlock, k1: float, b: float) -> np.ndarray:
        """A line per slot, a column per query: no score in the slot is greater; 0 where no term is shared."""
        scores = kx.Scorer(self.headers, block, k1, b).bounds(slice(0, len(self.slots))).astype(np.float64)
        return np.where(scores > 0, scores * (1 + kx._SLACK) + kx._LEAST_GAP, 0.0)

    def some(self, wanted: np.ndarray) -> kx.Claims:
        """The claims of the slots wanted."""
        if wanted.all():
            return self.claims
        use = np.repeat(wanted, np.diff(self.ends))
        post = use[self.claims.row]
        row = (np.cumsum(use) - 1)[self.claims.row[post]]
        of = self.claims
        return kx.Claims(of.ids.take(pa.array(np.flatnonzero(use))), of.names, row, of.term[post], of.tf[post], of.dl[post])


def _chunks(batches: Iterable[pa.RecordBatch], buckets: int, hold: int) -> Iterator[Slots]:
    """Index rows of about ``hold`` bytes at a time."""
    for batch in batches:
        step = max(1, batch.num_rows * hold // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield Slots(pa.Table.from_batches([batch.slice(at, step)]), buckets)


def own_batches(batches: Iterable[pa.RecordBatch], path: str, parts: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(claim_id, dl, terms) of the claims whose ids are stored below ``path``: the greatest length and the different terms."""
    for chunk in _chunks(batches, buckets, _HOLD):
        claims = chunk.claims
        for part in range(parts):
            for stored in vx.stored_files(path, part):
                found = np.flatnonzero(kx.pc.is_in(claims.ids, value_set=stored.column("claim_id").combine_chunks()).to_numpy(zero_copy_only=False))
                if not len(found):
                    continue
                starts = np.searchsorted(claims.row, found)
                sizes = np.searchsorted(claims.row, found, "right") - starts
                at, line = kx._spans(starts, sizes), np.repeat(np.arange(len(found)), sizes)
                line, term, _ = kx.counted(line, claims.term[at], len(claims.names))
                yield pa.RecordBatch.from_arrays(
                    [claims.ids.take(pa.array(found)), _ints(chunk.longest[found]), _lists(np.searchsorted(line, np.arange(len(found) + 1)), claims.names.take(pa.array(term)))],
                    names=["claim_id", "dl", "terms"],
                )


def first_batches(batches: Iterable[pa.RecordBatch], path: str, parts: int, n: int, buckets: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """From headers alone: the ``n`` best-bounded slots of each query, (query_id, slot, bound), and one row per query with the
    number of slots that share a term with it (``seen``) and whether all do (``all``)."""
    held: dict[int, list] = {}
    blocks = kx.query_blocks(path, parts)
    for chunk in _chunks(batches, buckets, _HOLD):
        for part, block in blocks:
            bound = chunk.bounds(block, k1, b)
            ids, best, slot, seen, total = held.get(part) or [block.ids, np.zeros((0, len(block))), np.zeros((0, len(block)), np.int64), 0, 0]
            best = np.concatenate([best, bound])
            slot = np.concatenate([slot, np.repeat(chunk.slots[:, None], len(block), axis=1)])
            order = np.lexsort((slot, -best), axis=0)[:n]
            held[part] = [ids, np.take_along_axis(best, order, 0), np.take_along_axis(slot, order, 0), seen + (bound > 0).sum(axis=0), total + len(bound)]
    for ids, best, slot, seen, total in held.values():
        at, query = np.nonzero(best > 0)
        none = lambda kind, size=len(query): pa.nulls(size, kind)
        names = ["query_id", "slot", "bound", "seen", "all"]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(slot[at, query]), pa.array(best[at, query]), none(pa.int64()), none(pa.bool_())], names=names)
        every = len(ids)
        yield pa.RecordBatch.from_arrays([ids, pa.nulls(every, pa.int64()), pa.nulls(every, pa.float64()), pa.array(seen.astype(np.int64)), pa.array(seen == total)], names=names)


def _stored(path: str, part: int) -> pa.Table | None:
    tables = list(vx.stored_files(path, part))
    return pa.concat_tables(tables) if tables else None


def _numbered(block: kx.QueryBlock, ids: pa.ChunkedArray) -> np.ndarray:
    """The number in the block of each query id, -1 if it is not there."""
    return kx.pc.index_in(ids.combine_chunks().cast(pa.string()), value_set=block.ids.cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _wanted(block: kx.QueryBlock, chunk: Slots, stored: pa.Table | None, column: str) -> np.ndarray:
    """A line per slot, a column per query: whether the pair is stored."""
    need = np.zeros((len(chunk.slots), len(block)), bool)
    if stored is not None:
        order = np.argsort(chunk.slots)
        slot, query = stored.column(column).to_numpy(), _numbered(block, stored.column("query_id"))
        at = order[np.minimum(np.searchsorted(chunk.slots[order], slot), len(order) - 1)]
        hit = (chunk.slots[at] == slot) & (query >= 0)
        need[at[hit], query[hit]] = True
    return need


def score_first(batches: Iterable[pa.RecordBatch], path: str, firsts: str, parts: int, n: int, buckets: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Scores in the stored (query_id, in_slot) pairs: (query_id, raw_score) of the ``n`` best per slot, and one row per
    pair that tells whether the slot holds a claim without a term of the query (``open``)."""
    blocks = kx.query_blocks(path, parts)
    for chunk in _chunks(batches, buckets, _HOLD):
        for part, block in blocks:
            scorer = kx.Scorer(chunk.claims, block, k1, b)
            for at, query in zip(*np.nonzero(_wanted(block, chunk, _stored(firsts, part), "in_slot"))):
                rows = np.arange(chunk.ends[at], chunk.ends[at + 1])
                score, shared = scorer.exact(int(query), rows)
                others = len(rows) - scorer.own_among(int(query), rows[0], rows[-1] + 1)
                score = np.sort(score[shared])[::-1]
                yield pa.RecordBatch.from_arrays(
                    [block.ids.take(pa.array(np.full(len(score[:n]) + 1, query))), pa.array([*score[:n].tolist(), None], pa.float64()),
                     pa.array([*[None] * len(score[:n]), len(score) < others], pa.bool_())], names=["query_id", "raw_score", "open"]
                )


def score_slots(
    batches: Iterable[pa.RecordBatch], path: str, firsts: str, limits: str, parts: int, n: int, buckets: int, k1: float, b: float
) -> Iterator[pa.RecordBatch]:
    """The ``n`` best hits per query in the slots whose bound reaches the query's stored limit, in those read first and, without a limit, in all;
    beside one row per query with the claims that match, the least score if all do, and the number of slots read."""
    best: dict[int, tuple[pa.Array, kx.Best, np.ndarray]] = {}
    blocks = kx.query_blocks(path, parts)
    for chunk in _chunks(batches, buckets, _HOLD):
        for part, block in blocks:
            stored, least = _stored(limits, part), np.full(len(block), -np.inf)
            if stored is not None:
                number, value = _numbered(block, stored.column("query_id")), stored.column("least").to_numpy()
                least[number[number >= 0]] = value[number >= 0]
            need = np.ones((len(chunk.slots), len(block)), bool)
            if np.isfinite(least).any():
                bound = chunk.bounds(block, k1, b)
                need = ((bound > 0) & (bound >= least)) | ~np.isfinite(least) | _wanted(block, chunk, _stored(firsts, part), "in_slot")
            _, found, read = best.setdefault(part, (block.ids, kx.Best(n, len(block)), np.zeros(len(block), np.int64)))
            if not read.any():
                found.least = np.maximum(found.least, least)
            read += need.sum(axis=0)
            if need.mean() < _FEW:
                scorer = kx.Scorer(chunk.claims, block, k1, b)
                for at, query in zip(*np.nonzero(need)):
                    found.add_rows(scorer, int(query), np.arange(chunk.ends[at], chunk.ends[at + 1]))
            else:
                found.add(kx.Scorer(chunk.some(need.any(axis=1)), block, k1, b))
    for ids, found, read in best.values():
        for scored in found.batches(ids):
            yield scored.append_column("slots_read", pa.nulls(scored.num_rows, pa.int64()))
        none = lambda kind: pa.nulls(len(ids), kind)
        yield pa.RecordBatch.from_arrays([ids, none(pa.string()), none(pa.float64()), none(pa.int64()), none(pa.float64()), pa.array(read)], names=[*kx._SCORED, "slots_read"])
