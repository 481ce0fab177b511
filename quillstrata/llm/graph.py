"""Connected components of a link table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.sources import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Return (id, component): the smallest id reachable over ``links`` (a, b), a table of ``scratch``.

    Labels fall to the least label of a neighbour, then jump to the label of
    their label, until none falls. Each step is one join that Spark may split
    for a hub, and one combining aggregate; its table replaces the one before.
    Empty links give an empty table; loops and repeated links are harmless.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = scratch.write(pairs.union(pairs.select("b", "a")).distinct())
    labels = scratch.write(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.col("id").alias("old"), F.least("id", "m").alias("component")))
    while not labels.where("component <> old").isEmpty():
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        stepped = scratch.write(low.join(jump, "low", "left").select("id", "old", F.least("low", F.coalesce("far", "low")).alias("component")))
        scratch.drop(labels)
        labels = stepped
    scratch.drop(edges)
    return labels.select("id", "component")
