"""Runs of bytes in texts as numpy and Arrow arrays, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, U64, flat, prefix_hash, span_hash

#: Bytes of text that one step handles; a longer text is a step of its own.
BLOCK = 8 << 20


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, lower-cased bytes, offsets from 0) of at most `most` bytes, one row at least; batches are joined up to that."""
    most = most or BLOCK
    held: list[pa.RecordBatch] = []
    size = 0

    def ready():
        table = pa.Table.from_batches(held)
        held.clear()
        buf, off = flat(table.column(text))
        lo, n = 0, len(off) - 1
        while lo < n:
            hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1), n)
            yield table.slice(lo, hi - lo), LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
            lo = hi

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= most:
            yield from ready()
            size = 0
    if held:
        yield from ready()


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every longest run of true bytes within the rows off[i]:off[i+1]; off starts at 0."""
    n = len(inside)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the slices start:end of buf, one after another."""
    size = end - start
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.repeat(start - off[:-1], size)
    at += np.arange(off[-1])
    return buf[at], off


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """The slices between offsets as an array of strings."""
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def coded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each slice, the distinct slices): equal codes are equal bytes."""
    found = strings(*gather(buf, start, end)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """(code of each row, the distinct values)."""
    found = column.combine_chunks().dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def keys_of(found: pa.Array) -> np.ndarray:
    """A 64-bit key of each string."""
    if not len(found):
        return np.zeros(0, U64)
    off = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return span_hash(prefix_hash(data), off[:-1] - off[0], off[1:] - off[0])
