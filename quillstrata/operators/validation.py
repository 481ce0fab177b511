"""Integrity checks of a projection: each check is a table of failing rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved(rows: DataFrame, reference: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no known record."""
    return rows.where(F.col(reference).isNotNull()).join(known.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def miscounted(owners: DataFrame, members: DataFrame, key: str, declared: str) -> DataFrame:
    """Owners whose declared number of members is not the real one."""
    real = members.groupBy(key).agg(F.count("*").alias("real"))
    return owners.join(real, key, "left").where(F.col(declared) != F.coalesce("real", F.lit(0)))


def unequal_lists(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose lists differ between two tables."""
    return left.select(key, F.col(column).alias("a")).join(right.select(key, F.col(column).alias("b")), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def incidence_faults(occurrences: DataFrame, listed: DataFrame) -> DataFrame:
    """Occurrences that are not listed on their source or their target.

    ``occurrences`` has occurrence_id, source_id and target_id; ``listed`` has
    record_id and occurrence_id.
    """
    ends = occurrences.select("occurrence_id", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("record_id")) for s in ("source", "target")))))
    return ends.where("record_id is not null").join(listed, ["record_id", "occurrence_id"], "left_anti")


def missing_transitions(occurrences: DataFrame, transitions: DataFrame) -> DataFrame:
    """(source kind, target kind) pairs of occurrences without all four typed transitions."""
    kinds = occurrences.select("source_kind", "target_kind").distinct()
    rows = F.array(
        F.struct(F.col("source_kind").alias("from_kind"), F.lit("outgoing").alias("direction"), F.lit("occurrence").alias("to_kind")),
        F.struct(F.lit("occurrence").alias("from_kind"), F.lit("outgoing").alias("direction"), F.col("target_kind").alias("to_kind")),
        F.struct(F.col("target_kind").alias("from_kind"), F.lit("incoming").alias("direction"), F.lit("occurrence").alias("to_kind")),
        F.struct(F.lit("occurrence").alias("from_kind"), F.lit("incoming").alias("direction"), F.col("source_kind").alias("to_kind")),
    )
    wanted = kinds.select("source_kind", "target_kind", F.inline(rows))
    return wanted.join(transitions.select("from_kind", "direction", "to_kind").distinct(), ["from_kind", "direction", "to_kind"], "left_anti")


def undated_anchors(anchors: DataFrame, dated: DataFrame) -> DataFrame:
    """Anchors on subjects that are not dated."""
    return anchors.join(dated, "object_id", "left_anti")


def coverage_faults(surfaces: DataFrame) -> DataFrame:
    """Surfaces whose coverage does not fit: exact ones are exhaustive and count, others are bounded."""
    exact = F.col("kind") == "exact"
    right = F.when(exact, (F.col("coverage") == "exhaustive") & F.col("total_count")).otherwise(F.col("coverage") == "bounded")
    return surfaces.where("available").where(~right)


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """Return (check_name, failures, passed): one row a check."""
    parts = [rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check_name"), "failures", (F.col("failures") == 0).alias("passed")) for name, rows in sorted(checks.items())]
    return reduce(DataFrame.unionByName, parts)
