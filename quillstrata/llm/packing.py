"""Best-fit packing of token sequences with certified bin counts.

Each partition of pieces is packed by best-fit decreasing. Dual feasible
functions give a lower bound on the bins its pieces need: a partition that meets
its bound is certified. The pieces in unfilled bins of the others are exchanged
(dealt anew over all such partitions) and packed again, for as long as that
saves bins. A partition has a bounded number of pieces; only lengths move, never
token ids.

Defined results: a null or empty text is the end token alone; every input row is
a document of its own, so repeated rows and repeated or null ids are packed once
each; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import doc_blocks, integer_id, map_batches, utf8
from quillstrata.llm.tokens import encode
from quillstrata.sources import Scratch

#: Bytes of text encoded at once.
BLOCK = 6 << 20
#: Pieces of one partition; more pieces make more partitions.
PART = 20_000
#: Parameters of the staircase dual feasible functions.
STAIRS = tuple(range(1, 13))

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(df: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = 1024, end: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return the pieces of every document, with their token ids if asked.

    A document is its ids and the end token. One longer than ``capacity`` is cut
    into pieces of that length, of which the first may be shorter.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in doc_blocks(offsets, BLOCK):
                ids, at = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vocabulary)
                ids = np.insert(ids, at[1:], end).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                begin = at[:-1][doc] + start
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(doc)), *(pa.array(x, t) for x, (_, t) in zip((piece, start, length, sums), fields[1:], strict=True))]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1:]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, _PIECES + ", ids array<long>" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place lengths, longest first, each in the fullest bin it fits: (bin, offset)."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    for k in order.tolist():
        n = int(lengths[k])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b, used = capacity, used, used + 1
        bins[k], offsets[k] = b, capacity - r
        if r > n:
            if not room[r - n]:
                open_rooms |= 1 << (r - n)
            room[r - n].append(b)
    return bins, offsets


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """Return a number of bins that no packing of ``lengths`` can undercut.

    The greatest of the bounds by dual feasible functions: thresholds that round
    long pieces up to a bin and drop short ones, and staircases of them.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for cut in range(0, capacity // 2 + 1):
        y = np.where(x > capacity - cut, capacity, np.where(x < cut, 0, x))
        best = max(best, -(-int((count * y).sum()) // capacity))
        if cut % 16 == 0:
            for k in STAIRS:
                steps = (k + 1) * y
                z = np.where(steps % capacity == 0, y * k, steps // capacity * capacity)
                best = max(best, -(-int((count * z).sum()) // (capacity * k)))
    return best


def _pack_part(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        used, bound = len(filled), bin_bound(lengths, capacity)
        extra = {"bin": bins, "offset": offsets, "free": capacity - filled[bins], "opens": (offsets == 0).astype(np.int64), "gap": np.full(len(bins), used - bound)}
        for name, values in extra.items():
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return table

    return run


def _round(items: DataFrame, n: int, number: int, capacity: int, scratch: Scratch) -> DataFrame:
    parts = max(1, math.ceil(n / PART))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)).cast("long")).withColumn("round", F.lit(number).cast("long"))
    return scratch.write(dealt.groupBy("part").applyInArrow(_pack_part(capacity), dealt.schema))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place pieces (with a ``length`` of at most ``capacity``) in sequences.

    Returns the pieces with ``sequence_id`` and ``offset``; offsets in a sequence
    have no gaps.
    """
    zero = F.lit(0).cast("long")
    names = ("part", "round", "bin", "offset", "free", "opens", "gap")
    scratch = Scratch(pieces.sparkSession)
    items = scratch.write(pieces.withColumn("item", F.monotonically_increasing_id()).withColumns(dict.fromkeys(names, zero)))
    current = _round(items, items.count(), 0, capacity, scratch)
    scratch.drop(items)
    exchanged = F.expr("gap > 0 and free > 0")
    done: list[DataFrame] = []
    for number in itertools.count(1):
        pool = current.where(exchanged)
        n, before = pool.agg(F.count("*"), F.coalesce(F.sum("opens"), F.lit(0))).first()
        if not n:
            break
        again = _round(pool, n, number, capacity, scratch)
        if again.agg(F.sum("opens")).first()[0] >= before:
            scratch.drop(again)
            break
        done.append(current.where(~exchanged))
        current = again
    for part in done:
        current = current.unionByName(part)
    sequence = F.shiftleft("round", 50) + F.shiftleft("part", 20) + F.col("bin")
    return current.select(*pieces.columns, sequence.alias("sequence_id"), "offset")


def assemble(packed: DataFrame) -> DataFrame:
    """Return (sequence_id, ids): the token ids of each sequence, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
