"""Vectorised helpers that work on the byte buffers of Arrow string columns inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from schemaweave.llm.shared import BATCH_BYTES

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total, at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back at the end of a task: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts and the last one ends; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run outside [\\x20\\x09-\\x0D], and the number of words before each row."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers.get(which, ())) < n:
        steps = np.full(max(n, _CHUNK * 2), _BASE if which == "up" else _BASE_INVERSE, U64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which]


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered over the whole range."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in ascending order, and may overlap only within a chunk."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + _CHUNK)))
        a, b = starts[at:to] - base, ends[at:to] - base
        part = data[base : base + b.max()].astype(U64) + U64(1)
        part *= _power("up", len(part))[: len(part)]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=total[1:])
        out[at:to] = mixed((total[b] - total[a]) * _power("down", len(part))[a] + (b - a).astype(U64))
        at = to
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive values, across rows too."""
    if len(hashes) < width:
        return np.zeros(0, U64)
    n = len(hashes) - width + 1
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(_BASE) + hashes[k : k + n]
    return mixed(out)


def window_starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows lie within a row: their first item, and their row. bounds: number of items before each row."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[rows], rows


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; an empty row has 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def spans_of_rows(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places from each first to before each stop, end to end."""
    counts = stop - first
    return np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
