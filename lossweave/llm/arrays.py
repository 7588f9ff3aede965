"""Numpy helpers over Arrow string columns: bytes, words and rolling 64-bit hashes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        out = np.ones(1 << max(10, (count - 1).bit_length()), np.uint64)
        done = 1
        while done < len(out):
            out[done : 2 * done] = out[:done] * U64(pow(base, done, 2**64))
            done *= 2
        _POWERS[base] = have = out
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize)
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``size`` bytes of text (one longer text stays whole)."""
    offsets = text_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (by default ``[^\\x20\\x09-\\x0D]+``), and per row the index of its first."""
    inside = ~white[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes everywhere."""
    out = np.empty(len(starts), np.uint64)
    longest = int((ends - starts).max()) if len(starts) else 0
    weights = _powers(_BASE, max(1 << 10, longest))
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        first = starts[at:stop] - lo
        place = np.arange(hi - lo)
        place -= np.repeat(first, np.diff(np.append(first, hi - lo)))
        gap = place >= np.repeat(ends[at:stop] - starts[at:stop], np.diff(np.append(first, hi - lo)))
        place[gap] = 0
        value = _BYTES[data[lo:hi]] * weights[place]
        value[gap] = 0
        out[at:stop] = np.add.reduceat(value, first)
        at = stop
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` 64-bit values; entry i covers values[i : i + length]."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for at in range(0, count, BLOCK):
        stop = min(count, at + BLOCK)
        part = values[at : stop + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(_BASE, len(part)), out=sums[1:])
        out[at:stop] = (sums[length:] - sums[:-length]) * _powers(_INVERSE, stop - at)
    return mix(out)


def byte_window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` bytes."""
    count = len(data) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for at in range(0, count, BLOCK):
        stop = min(count, at + BLOCK)
        out[at:stop] = window_hashes(_BYTES[data[at : stop + length - 1]], length)
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by running minima from both ends of blocks."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of the base, of which ``stretch_hashes`` takes differences."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each stretch of values; equal content gives equal hashes wherever it stands."""
    values = (sums[starts + lengths] - sums[starts]) * _powers(_INVERSE, len(sums))[starts]
    return mix(values ^ mix(lengths.astype(np.uint64)))
