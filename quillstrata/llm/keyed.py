"""Joins of rows to a table of facts by key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one row in so many is heavy; there are no more heavy keys than that.
SHARE = 1000


def heavy_keys(counts: DataFrame, total: int, count_col: str = "rows") -> DataFrame:
    """Return the rows of ``counts`` whose count is a ``SHARE``-th of ``total`` or more."""
    return counts.where(F.col(count_col) * SHARE >= total)


def join_facts(rows: DataFrame, facts: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` to ``facts`` (one row a key) that no heavy key holds up.

    ``heavy`` has the facts of the heavy keys, ``SHARE`` at most: they are sent to the
    rows, which stay where they are. The rows of all other keys meet their facts by a
    shuffle. A null key is a key like others.
    """
    kept = [c for c in facts.columns if c != key]
    few = F.broadcast(heavy.select(F.col(key).alias("_key"), *kept))
    rest = facts.select(F.col(key).alias("_key"), *kept)
    same = F.col(key).eqNullSafe(F.col("_key"))
    near = rows.join(few, same)
    far = rows.join(F.broadcast(few.select("_key")), same, "left_anti").join(rest, same)
    return near.drop("_key").unionByName(far.drop("_key"))
