"""Packing of token ids into fixed-length sequences: first-fit decreasing in randomised groups.

Every document is encoded once; its ids and an end id are cut into full pieces and a rest. A full piece is a
sequence by itself. The rests of a group of some thousand documents (dealt by a hash) are packed by
first-fit decreasing; a tournament tree over the bins' free room finds the first bin that fits in
logarithmic time. Only the pieces' sizes travel to the groups, unless the ids are asked for.

Plain byte-level BPE files are loaded as ranked byte strings, whose encoder gives the ids of ``tokenizers``
several times faster (compared in the tests for every character class); other files go to ``tokenizers``.

Defined results: null text is empty text, of which the end id alone is packed; each row is a document of its
own, also if ids repeat or are null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from lossweave.llm.arrays import mix
from lossweave.llm.tables import pin

#: The splitting rule of byte-level vocabularies (a fixed value), possessive where nothing can be given back.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _ranked(path: str) -> tiktoken.Encoding | None:
    """The vocabulary as ranked byte strings; None if the file is no plain byte-level BPE whose ids follow its
    merges."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, split, added = described["model"], described["pre_tokenizer"] or {}, described["added_tokens"]
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    odd = described["normalizer"] or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "end_of_word_suffix"))
    if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [words.get(w) for w in joined] != list(range(256, 256 + len(joined))):
        return None
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    _shared: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.ranked, self.tokenizer = _ranked(path), Tokenizer.from_file(path)

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One per worker process, which runs many tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, text: str) -> bytes:
        if self.ranked:
            try:
                return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # runs of white space longer than its pattern matcher's stack end in a panic
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, keep_ids: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, deal, ids): each document's ids, cut at multiples of
    ``length``. ``deal`` is a hash for the random groups; ``ids`` is null unless asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder.shared(tokenizer), 0
        for batch in batches:
            rows = []
            for number, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text_.as_py() or "") + end
                total = len(ids) // 4
                row += 1
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((number, start, len(part) // 4, zlib.crc32(part), total, row, part if keep_ids else None))
            columns = list(zip(*rows)) or [()] * 7
            starts, sums, order = (np.array(columns[i], np.uint64) for i in (1, 3, 5))
            deal = mix(mix(sums ^ (order << np.uint64(32))) ^ starts) >> np.uint64(1)
            kinds = [pa.int64()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(deal.astype(np.int64)), pa.array(columns[6], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids"],
            )

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long, ids binary")


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the order given, by first fit. The inner nodes of the tree hold the
    larger room of their two children, so the first bin with enough room is found from the root."""
    leaves = 1 << max(1, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _pack_group(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        sizes = group.column("length").to_numpy()
        order = np.lexsort((group.column("start").to_numpy(), group.column("deal").to_numpy(), -sizes))
        full = int((sizes == capacity).sum())
        bins, offsets = first_fit(sizes[order[full:]].tolist(), capacity)
        sequence = np.empty(len(sizes), np.int64)
        offset = np.zeros(len(sizes), np.int64)
        sequence[order[:full]] = np.arange(full)
        sequence[order[full:]] = np.array(bins, np.int64) + full
        offset[order[full:]] = offsets
        sequence += group.column("group").to_numpy() << 32
        kept = group.drop_columns(["group", "deal"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, group_documents: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset. Sequences
    are filled gaplessly from offset 0; what is missing to ``length`` is padding."""
    parts = pin(pieces(docs, tokenizer, length, end_id, keep_ids), "pieces")
    groups = max(1, -(-parts.where("start = 0").count() // group_documents))
    dealt = parts.withColumn("group", F.col("deal") % groups)
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(_pack_group(length), columns)
