"""Array kernels over the UTF-8 buffers of Arrow string columns.

Words and n-grams are found and hashed with whole-array operations, a bounded
slice of bytes at a time, so a document of any length needs memory in
proportion to its words, not to its words times a Python object.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes hashed at once.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


#: Bytes that an operator gets at once.
BATCH_BYTES = 8 << 20


def release() -> None:
    """Give freed memory back, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df, run: Callable, schema):
    """``df.mapInArrow`` on batches of at most ``BATCH_BYTES`` bytes (one longer row stands alone).

    Workers give memory back after each task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(cut(batches))
        finally:
            release()

    return df.mapInArrow(freed, schema)


def integer_id(df: DataFrame, name: str) -> Column:
    """Return the id column as longs; ids of another type raise ``TypeError`` at once."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{name} has type {kind.simpleString()}; ids are integers")
    return F.col(name).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Return (bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def doc_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Split documents into runs of about ``limit`` units; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


@functools.cache
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


@functools.cache
def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def series(x: int) -> np.ndarray:
        step = np.full(SLICE + 1, x, np.uint64)
        step[0] = 1
        return np.multiply.accumulate(step)

    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """Return ``n`` odd 64-bit constants that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash the byte spans [starts, ends), which must be sorted and disjoint."""
    table = lower_table() if table is None else table
    wide = table.astype(np.uint64) + np.uint64(1)
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    k, n = 0, len(starts)
    while k < n:
        base = int(starts[k])
        j = int(np.searchsorted(ends, base + SLICE, "right"))
        if j <= k:  # one span beyond the slice: fold it piece by piece
            total, scale, end = 0, 1, int(ends[k])
            for p in range(base, end, SLICE):
                piece = wide[data[p : min(end, p + SLICE)]]
                total = (total + scale * int((piece * up[: len(piece)]).sum(dtype=np.uint64))) & _MASK
                scale = (scale * pow(_BASE, len(piece), 1 << 64)) & _MASK
            out[k] = total
            k += 1
            continue
        part = wide[data[base : int(ends[j - 1])]]
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s = starts[k:j] - base
        out[k:j] = (sums[ends[k:j] - base] - sums[s]) * down[s]
        k = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return (starts, ends, document index) of runs of bytes that are not ASCII white space."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_space()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (hash, document index) of every word, A-Z lower-cased."""
    starts, ends, doc = word_spans(data, offsets)
    return span_hashes(data, starts, ends), doc


def shingle_sets(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Return (values, offsets): each document's sorted set of k-word shingles.

    A document of fewer words has its whole sequence as one shingle; one without
    words has an empty set.
    """
    counts = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    factors = constants(k, 0x51)
    n = len(hashes)
    if n >= k:
        grams = hashes[: n - k + 1] * factors[0]
        for j in range(1, k):
            grams += hashes[j : n - k + 1 + j] * factors[j]
        whole = doc[: n - k + 1] == doc[k - 1 :]
        grams, owner = mix(grams[whole]), doc[: n - k + 1][whole]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = np.full(len(short), 0xA5A5A5A5, np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            at = np.minimum(begin[short] + j, n - 1)
            extra += np.where(has, hashes[at] * factors[j] + np.uint64(j + 1), np.uint64(0))
        at = np.searchsorted(owner, short)
        grams, owner = np.insert(grams, at, mix(extra)), np.insert(owner, at, short)
    offsets = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n_docs), out=offsets[1:])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=n_docs), out=out[1:])
    return grams[keep], out
