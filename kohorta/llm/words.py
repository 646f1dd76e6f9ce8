"""Words of many texts at once: numpy over the bytes of an Arrow batch, no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import runs

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column without nulls, offsets of its rows)."""
    c = column.cast(pa.large_binary())
    if not len(c):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset: c.offset + len(c) + 1]
    data = c.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(c) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of `lengths` bytes each as a string column."""
    off = np.zeros(len(lengths) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(lengths, out=off[1:])
    kind = pa.string() if off.dtype == np.int32 else pa.large_string()
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, row) of every maximal stretch of `inside` bytes; rows end a stretch."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return first, end, np.searchsorted(offsets, first, side="right") - 1


def numbered(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, first byte and end of one occurrence of each number): equal words have equal numbers."""
    size = end - first
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(size),
                                  [None, pa.py_buffer(off), pa.py_buffer(data[runs(first, size)])])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    some = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    some[ids] = np.arange(len(ids))
    return ids, first[some], end[some]
