"""Vectors compressed to one byte a part: codebooks learned on integer components.

A vector's components become integers, floor(SCALE * x), and are cut into equal
consecutive parts. Each part position has a codebook of at most ``ENTRIES`` entries,
which starts as that part of the vectors with the smallest ids. In each round all parts
go to the nearest entry (squared Euclidean distance; ties to the lower index), and
each entry that has parts becomes their componentwise floored mean.

The vectors are kept as columnar NumPy blocks: for each part position a matrix of
dimensions by vectors. A round is one ``treeAggregate`` over the blocks: distances
accumulate dimension by dimension over a tile of vectors, ``np.add.at`` adds the parts
to int64 tensors of sums and counts, and the tensors merge through a reduction tree.
The driver holds the codebooks and one tensor of their size, whatever the input.

All arithmetic is exact: 32-bit where the largest component allows it, else 64-bit,
else Python integers. Rounds give the same codebooks however blocks are cut or merged.

Defined results: rows whose vector is null, or holds a null or a component that is not
finite, are dropped. Repeated rows count each; of rows with one id, the one with the
smaller vector comes first; null ids come after all others. Null labels are one label.
Vectors of different lengths, or of a length that the parts do not divide, raise
``ValueError``; vectors without components have the codes and errors 0. Fewer vectors
than ``ENTRIES`` make smaller codebooks. Other columns are ignored; an empty table gives
no rows. An error beyond 64 bits raises ``OverflowError``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.llm.arrowtext import integer_id, map_batches
from quillstrata.llm.keyed import heavy_keys, join_facts
from quillstrata.sources import Scratch

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors of one block, and of one tile of distances.
BLOCK = 8192
TILE = 1024

Codebooks = np.ndarray  # (parts, entries, dimensions), integers
_BLOCK = "ids array<long>, labels array<{label}>, size int, wide int, part binary"


def scaled(values: np.ndarray) -> np.ndarray:
    """Return floor(SCALE * x) of finite components, as int64 or, beyond it, Python integers."""
    wide = values.astype(np.float64) * SCALE
    if not len(wide) or np.abs(wide).max() < 2.0**62:
        return np.floor(wide).astype(np.int64)
    return np.array([math.floor(Fraction(x) * SCALE) for x in values.tolist()], object)


def _dense(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
    """Return (vectors by components, rows) of the usable rows of a batch."""
    lists = batch.column("embedding")
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    good = flat.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.zeros(len(good) + 1, np.int64)
    np.cumsum(~good, out=bad[1:])
    whole = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    sizes = np.unique(lengths[whole])
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} components")
    size = int(sizes[0]) if len(sizes) else 0
    taken = np.repeat(whole, np.maximum(lengths, 0))
    return flat.fill_null(0).to_numpy(zero_copy_only=False)[taken].reshape(int(whole.sum()), size), batch.filter(pa.array(whole))


def _store(values: np.ndarray) -> tuple[int, bytes]:
    """Return the bytes of integers in the narrowest width that holds them; 0 for decimal digits."""
    if values.dtype == object:
        return 0, ",".join(map(str, values.ravel())).encode()
    peak = int(np.abs(values).max()) if values.size else 0
    width = next(w for w in (2, 4, 8) if peak < 1 << (8 * w - 1))
    return width, values.astype(f"<i{width}").tobytes()


def _load(width: int, data: bytes, shape: tuple[int, int, int]) -> np.ndarray:
    """Return the integers of a block as (parts, dimensions, vectors)."""
    if width:
        return np.frombuffer(data, f"<i{width}").reshape(shape)
    return np.array([int(x) for x in bytes(data).split(b",")], object).reshape(shape)


def blocks(df: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """Return the usable vectors in columnar blocks: ids, labels, size, width and components by part and dimension."""
    label = df.schema[label_col].dataType if label_col else T.NullType()
    label = T.StringType() if isinstance(label, T.NullType) else label
    kind = df.schema[vector_col].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{vector_col} has type {kind.simpleString()}; vectors are arrays")
    rows = df.select(integer_id(df, id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), (F.col(label_col) if label_col else F.lit(None)).cast(label).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.RecordBatch]] = []

        def block() -> pa.RecordBatch:
            vectors = np.concatenate([v for v, _ in held])
            table = pa.Table.from_batches([r for _, r in held])
            n, size = vectors.shape
            if size % parts:
                raise ValueError(f"{parts} parts do not divide {size} components")
            columns = scaled(vectors.ravel()).reshape(n, parts, size // parts).transpose(1, 2, 0)
            width, data = _store(columns)
            whole = lambda name: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(name).combine_chunks())
            return pa.RecordBatch.from_arrays([whole("vec_id"), whole("label"), pa.array([size], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary())], names=["ids", "labels", "size", "wide", "part"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                vectors, kept = _dense(batch.slice(at, BLOCK))
                if not kept.num_rows:
                    continue
                if held and vectors.shape[1] != held[0][0].shape[1]:
                    raise ValueError(f"vectors of {held[0][0].shape[1]} and of {vectors.shape[1]} components")
                held.append((vectors, kept))
                if sum(r.num_rows for _, r in held) >= BLOCK:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return map_batches(rows, run, _BLOCK.format(label=label.simpleString()))


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (entry, squared distance) for each column of a part: (dimensions, vectors) against (entries, dimensions)."""
    dimensions, n = columns.shape
    kind = object
    if columns.dtype != object and book.dtype != object:
        peak = max(int(np.abs(x).max()) if x.size else 0 for x in (columns, book))
        room = (2 * peak) ** 2 * max(1, dimensions)
        kind = np.int32 if room < 1 << 31 else np.int64 if room < 1 << 63 else object
    columns, book = columns.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    entry, distance = np.empty(n, np.int64), np.empty(n, kind if kind is object else np.int64)
    for i in range(0, n, TILE):
        tile = columns[:, i : i + TILE]
        total = np.zeros((tile.shape[1], book.shape[1]), kind)
        for values, centres in zip(tile, book, strict=True):
            gap = values[:, None] - centres
            gap *= gap
            total += gap
        at = np.argmin(total, axis=1)
        entry[i : i + TILE], distance[i : i + TILE] = at, total[np.arange(len(at)), at]
    return entry, distance


Tensors = tuple[np.ndarray, np.ndarray] | None


def _gather(books: Codebooks, exact: bool):
    def add(tensors: Tensors, row) -> Tensors:
        parts, entries, dimensions = books.shape
        n = len(row["ids"])
        columns = _load(row["wide"], row["part"], (parts, dimensions, n))
        kind = object if exact else np.int64
        sums, counts = tensors or (np.zeros(books.shape, kind), np.zeros((parts, entries), np.int64))
        for p in range(parts):
            entry, _ = nearest(columns[p], books[p])
            np.add.at(sums[p], entry, columns[p].T.astype(kind))
            np.add.at(counts[p], entry, 1)
        return sums, counts

    return add


def _merge(a: Tensors, b: Tensors) -> Tensors:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def train(packed: DataFrame, start: Codebooks, rounds: int, total: int) -> Codebooks:
    """Return the codebooks after ``rounds`` rounds over a table of blocks of ``total`` vectors."""
    # Sums of 64 bits hold all vectors if the widest components do; else they are Python integers.
    widths = [r["wide"] for r in packed.select("wide").distinct().collect()]
    exact = 0 in widths or start.dtype == object or max(1, total) << (8 * max(widths, default=2) - 1) >= 1 << 63
    rows = packed.select(F.size("ids").alias("n"), "ids", "size", "wide", "part").rdd
    books = start
    for _ in range(rounds):
        sums, counts = rows.treeAggregate(None, _gather(books, exact), _merge, depth=3) or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        used = counts > 0
        books = books.astype(object) if exact else books.copy()
        books[used] = sums[used] // counts[used][:, None]
    return books


def start_books(df: DataFrame, parts: int, entries: int, id_col: str, vector_col: str) -> Codebooks:
    """Return the parts of the ``entries`` vectors with the smallest ids, which come to the driver."""
    vector = F.col(vector_col).cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first = df.select(integer_id(df, id_col).alias("vec_id"), vector.alias("embedding")).where(usable).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    sizes = sorted({len(r["embedding"]) for r in first}) or [0]
    if len(sizes) > 1 or sizes[0] % parts:
        raise ValueError(f"{parts} equal parts of vectors of {sizes} components")
    flat = scaled(np.array(list(itertools.chain.from_iterable(r["embedding"] for r in first)), np.float64))
    return np.ascontiguousarray(flat.reshape(len(first), parts, sizes[0] // parts).transpose(1, 0, 2))


def digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(packed: DataFrame, books: Codebooks) -> DataFrame:
    """Return (vec_id, label, code, error) of every vector of a table of blocks."""
    label = packed.schema["labels"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                size = batch.column("size")[k].as_py()
                if size != books.shape[0] * books.shape[2]:
                    raise ValueError(f"vectors of {size} and of {books.shape[0] * books.shape[2]} components")
                columns = _load(batch.column("wide")[k].as_py(), batch.column("part")[k].as_buffer(), (books.shape[0], books.shape[2], len(ids)))
                found = [nearest(c, b) for c, b in zip(columns, books, strict=True)]
                codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                step = 2 * books.shape[0]
                error = sum(distance for _, distance in found)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([codes[i : i + step] for i in range(0, len(codes), step)], pa.string()), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    return map_batches(packed.select("ids", "labels", "size", "wide", "part"), run, f"vec_id long, label {label.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """Add ``vector``: the components that the code stands for, scaled back."""
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in entry)) for entry in book)) for book in books))
    at = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(table[p][at(p)] for p in range(len(books)))))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Return (vec_id, code, error, label_error, codebooks_sha256), one row a usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two digits has at most 256 entries")
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        packed = scratch.write(blocks(df, parts, id_col, vector_col, label_col))
        total = packed.agg(F.sum(F.size("ids"))).first()[0] or 0
        books = train(packed, start_books(df, parts, entries, id_col, vector_col), rounds, total)
        coded = Scratch(spark).write(encode(packed, books))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    heavy = heavy_keys(sums, total).drop("rows")
    joined = join_facts(coded, sums.drop("rows"), heavy, "label")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
