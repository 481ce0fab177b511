"""Shards of near equal sizes, by longest-processing-time scheduling.

Documents with equal texts stay together. The groups, longest first, go to the
least-loaded shard, which a heap gives. One heap cannot take the groups of a large
corpus, so the schedule has levels: groups are dealt into parts of a bounded number,
each part is scheduled to ``FINE`` bins a shard, and the bins are the next level's
groups, until one part is left. Groups that are long against a shard go to the
last level as they are, so do the bins of a few small parts, which even out what the
larger ones leave. Only sizes move; texts are read once.

A shard's size exceeds the mean by no more than the longest group (a group longer
than the mean has a shard to itself, as far as the others allow).

Defined results: a null text has no bytes and is one group with the empty text; every
input row is a document, so repeated rows and repeated or null ids have a place each;
other columns are ignored; an empty table gives no rows; ties go to the smaller group
hash and the smaller shard. Texts whose 64-bit hashes agree stay together as well.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import integer_id, map_batches
from quillstrata.llm.keyed import heavy_keys, join_facts
from quillstrata.sources import Scratch

#: Bytes that a document needs besides its text.
OVERHEAD = 16
#: Groups of one part; more groups make more parts.
PART = 10_000
#: Bins of a part for each shard.
FINE = 16
#: Share of a part that each of the small parts has.
SMALL = (1 / 8, 1 / 64, 1 / 512)


def schedule(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Longest-processing-time schedule: the shard of each size."""
    out = np.empty(len(sizes), np.int64)
    heap = [(0, shard) for shard in range(shards)]
    values = sizes.tolist()
    for k in np.argsort(-sizes, kind="stable").tolist():
        load, shard = heap[0]
        out[k] = shard
        heapq.heapreplace(heap, (load + values[k], shard))
    return out


def _schedule_part(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("level", "ascending"), ("item", "ascending")])
        bins = schedule(table.column("size").to_numpy(), shards)
        return table.append_column("bin", pa.array(bins, pa.int64()))

    return run


def _place(items: DataFrame, shards: int) -> DataFrame:
    return items.groupBy("part").applyInArrow(_schedule_part(shards), "level int, item long, size long, part long, bin long")


def _part(parts: int) -> Column:
    """One of ``parts`` parts, or one of the small ones that follow them, by the item's hash."""
    share = F.pmod(F.xxhash64("item", "level", F.lit(0x11)), F.lit(1 << 40)) / F.lit(1 << 40) * F.lit(parts + sum(SMALL))
    part, edge = F.lit(parts - 1), float(parts)
    for k, small in enumerate(SMALL):
        part = F.when(share >= edge, F.lit(parts + k)).otherwise(part)
        edge += small
    return F.when(share < parts, F.floor(share)).otherwise(part).cast("long")


def assign(groups: DataFrame, shards: int, scratch: Scratch, part_items: int = PART) -> DataFrame:
    """Return (item, shard) for ``groups`` (item, size), one row an item."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    long = F.col("size") * (shards * FINE) >= total
    levelled = groups.select(F.lit(0).alias("level"), "item", "size")
    last = levelled.where(long)
    items = levelled.where(~long)
    levels = []
    bins = shards * FINE
    while (n := items.count()) > part_items:
        level, parts = len(levels), math.ceil(n / part_items)
        placed = scratch.write(_place(items.withColumn("part", _part(parts)), bins))
        levels.append((placed, parts))
        sums = scratch.write(placed.groupBy("part", "bin").agg(F.sum("size").alias("size")).select("part", F.lit(level + 1).alias("level"), (F.col("part") * bins + F.col("bin")).alias("item"), "size"))
        last = last.unionByName(sums.where(F.col("part") >= parts).drop("part"))
        items = sums.where(F.col("part") < parts).drop("part")
    placed = scratch.write(_place(last.unionByName(items).withColumn("part", F.lit(0).cast("long")), shards))
    final = placed.select("level", "item", F.col("bin").alias("shard"))
    at = lambda level: final.where(F.col("level") == level).select("item", "shard")
    below = at(len(levels))
    for level, (placed, _) in reversed(list(enumerate(levels))):
        through = placed.select(F.col("item").alias("inner"), (F.col("part") * bins + F.col("bin")).alias("item")).join(below, "item")
        below = at(level).unionByName(through.select(F.col("inner").alias("item"), "shard"))
    return below


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the task's number and each row's place among the task's rows of its shard."""
    chunk, seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        if not len(shard):
            continue
        order = np.argsort(shard, kind="stable")
        counts = np.bincount(shard)
        if len(counts) > len(seen):
            seen = np.pad(seen, (0, len(counts) - len(seen)))
        ahead = np.cumsum(counts) - counts
        place = np.empty(len(shard), np.int64)
        place[order] = np.arange(len(shard)) - ahead[shard[order]] + seen[shard[order]]
        seen[: len(counts)] += counts
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), chunk), pa.int64()), pa.array(place)], names=[*batch.schema.names, "chunk", "place"])


def _settle(rows: DataFrame, shards: int, scratch: Scratch, part_items: int) -> DataFrame:
    """Add the shard of each row's group to ``rows``, which have the group's hash ``item`` and a ``size``."""
    groups = scratch.write(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    placed = scratch.write(assign(groups.select("item", "size"), shards, scratch, part_items))
    heavy = heavy_keys(groups, total).select("item").join(placed, "item")
    return join_facts(rows, placed, heavy, "item").drop("item")


def _size(text: Column) -> Column:
    return (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", part_items: int = PART) -> DataFrame:
    """Return (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row an input row.

    The law is ``bytes``: shards have near equal sizes. Slots number a shard's documents
    from 0. ``grown_shard`` is null, as the law says nothing about another number of shards.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with Scratch(spark) as scratch:
        rows = scratch.write(df.select(integer_id(df, id_col).alias("doc_id"), _size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("item")))
        settled = _settle(rows, shards, scratch, part_items)
        numbered = Scratch(spark).write(map_batches(settled, _number, "doc_id long, size long, text_crc32 long, shard long, chunk long, place long"))
    # One row a shard and task; what lies before a task's rows in its shard.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = numbered.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", before.alias("before"))
    return numbered.join(ahead, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(df: DataFrame, folder: str, shards: int = 40, text_col: str = "text", part_items: int = PART) -> None:
    """Write all columns of ``df`` below ``folder``, one subfolder ``shard=k`` a shard.

    Every task writes a file for each shard it has rows of; texts are not shuffled, but for
    the rows of groups that are not heavy, which meet their shard by the group's hash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.withColumns({"item": F.xxhash64(text), "size": _size(text)}) if not {"item", "size", "shard"} & set(df.columns) else None
    if rows is None:
        raise ValueError("columns named item, size or shard would be overwritten; rename them first")
    with Scratch(df.sparkSession) as scratch:
        _settle(rows, shards, scratch, part_items).drop("size").write.partitionBy("shard").parquet(folder)
