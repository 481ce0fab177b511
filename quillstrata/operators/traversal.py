"""Typed edges: following connections, walks of bounded depth, temporal operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.sources import Scratch, durable

EDGE = ("source_kind", "source_id", "transition_id", "direction", "target_kind", "target_id", "ord")


def edges(rows: DataFrame, source_kind: str, source: str, transition: str, target_kind: str, target: str, direction: str = "outgoing", order: str | None = None) -> DataFrame:
    """Return rows of a table as edges of one typed transition."""
    return rows.select(
        F.lit(source_kind).alias("source_kind"),
        F.col(source).cast("string").alias("source_id"),
        F.lit(transition).alias("transition_id"),
        F.lit(direction).alias("direction"),
        F.lit(target_kind).alias("target_kind"),
        F.col(target).cast("string").alias("target_id"),
        (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("ord"),
    )


def follow(start: DataFrame, edge_table: DataFrame, transition: str, direction: str = "outgoing") -> DataFrame:
    """Follow one transition from a binding (root, kind, id); repeated ends stay once."""
    typed = edge_table.where((F.col("transition_id") == transition) & (F.col("direction") == direction))
    found = start.join(typed, (start["kind"] == typed["source_kind"]) & (start["id"] == typed["source_id"]))
    return found.select("root", F.col("target_kind").alias("kind"), F.col("target_id").alias("id")).distinct()


def walk(start: DataFrame, edge_table: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """Return (root, depth, kind, id) of everything within ``depth`` steps; 0 is the start.

    Each step is one join; an end found at a lesser depth is not walked again. A
    layer that the next steps need is cut from its lineage, else every step would
    compute all steps before it anew.
    """
    layers = [start.select("root", F.lit(0).cast("long").alias("depth"), "kind", "id").distinct()]
    frontier = layers[0]
    typed = edge_table.where(F.col("direction") == direction)
    for step in range(1, depth + 1):
        found = frontier.join(typed, (frontier["kind"] == typed["source_kind"]) & (frontier["id"] == typed["source_id"]))
        found = found.select("root", F.lit(step).cast("long").alias("depth"), F.col("target_kind").alias("kind"), F.col("target_id").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, layers).select("root", "kind", "id")
        frontier = found.join(seen, ["root", "kind", "id"], "left_anti")
        frontier = durable(frontier) if step < depth else frontier
        layers.append(frontier)
    return reduce(DataFrame.unionByName, layers)


def earliest(anchors: DataFrame, binding: str, order: list[str], latest: bool = False) -> DataFrame:
    """One anchor of each binding: the first by ``order``, or the last.

    A combining aggregate: only one candidate of each binding leaves a task.
    """
    pick = F.max if latest else F.min
    return anchors.groupBy(binding).agg(pick(F.struct(*order)).alias("first")).select(binding, "first.*")


def temporal_order(anchors: DataFrame, group: str, order: list, position: str = "position") -> DataFrame:
    """Number the anchors of each group mechanically; null keys come last."""
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    return anchors.withColumn(position, F.row_number().over(Window.partitionBy(group).orderBy(*keys)).cast("long"))


def spread_order(anchors: DataFrame, group: str, order: list, scratch: Scratch, position: str = "position") -> DataFrame:
    """Number the anchors of each group as ``temporal_order`` does, a group being spread over tasks.

    Rows are dealt by ranges of group and keys, so that a group with most of the rows has as
    many ranges as it needs; each range is sorted, and a row's number is its place in the
    range and what the group has in the ranges before. The ranges are written to ``scratch``
    first, since two runs might draw them differently. Keys should tell rows apart: rows of
    a group with equal keys are in one range.
    """
    keys = [F.col(group), *(F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order)]
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ranges = anchors.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # Numbers rise by one within a range; those of different ranges differ in the upper bits.
    ranges = scratch.write(sorted_ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    counts = ranges.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_in"), (before - F.col("_first") + 1).alias("_shift"))
    joined = ranges.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_in")))
    return joined.select(*(c for c in anchors.columns if c != position), (F.col("_at") + F.col("_shift")).alias(position))


def running_sum(rows: DataFrame, group: list[str], order: str, value: str, scratch: Scratch) -> DataFrame:
    """Add ``sum``: what a group has of ``value`` up to and with each row; a group is spread over tasks as by ``spread_order``."""
    keys = [*group, order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scratch.write(rows.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*group, "_range").agg(F.sum(value).alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = F.sum(value).over(Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("sum", inside).join(totals, [*group, "_range"]).withColumn("sum", F.col("sum") + F.col("_before")).drop("_range", "_before")


def group_branches(branches: dict[str, DataFrame]) -> DataFrame:
    """Keep branches apart: their rows with a ``branch`` column."""
    return reduce(DataFrame.unionByName, (rows.withColumn("branch", F.lit(name)) for name, rows in sorted(branches.items())))


def concatenate(branches: dict[str, DataFrame]) -> DataFrame:
    """Append branches as a bag; the provenance is the branch's name."""
    return reduce(DataFrame.unionByName, (rows.withColumn("provenance", F.lit(name)) for name, rows in sorted(branches.items())))
