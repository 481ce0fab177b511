"""Set-based views of thread logs and records.

They give tables for whole corpora of threads what the fold gives for one: log
checks, categories, attention lenses, incidence, closure and bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_faults(log: DataFrame) -> DataFrame:
    """Return (thread_id, code, position): the first entry of each thread that is out of sequence.

    ``log`` has thread_id, ordinal, sequence and prior_state_version.
    """
    at = F.row_number().over(Window.partitionBy("thread_id").orderBy("ordinal")).cast("long")
    numbered = log.select("thread_id", "sequence", "prior_state_version", at.alias("at"))
    code = F.when(F.col("sequence") != F.col("at"), "accepted_entry_sequence_mismatch").when(F.col("prior_state_version") != F.col("at") - 1, "accepted_entry_prior_version_mismatch")
    faults = numbered.select("thread_id", (F.col("at") - 1).alias("position"), code.alias("code")).where("code is not null")
    return faults.groupBy("thread_id").agg(F.min(F.struct("position", "code")).alias("first")).select("thread_id", "first.position", "first.code")


def repeated_identities(log: DataFrame) -> DataFrame:
    """Return (thread_id, kind, identity, times) of identities accepted more than once."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("identity")) for k in ("contribution", "source_turn", "source_utterance")))
    return log.select("thread_id", F.inline(pairs)).groupBy("thread_id", "kind", "identity").agg(F.count("*").alias("times")).where("times > 1")


def attention_lens(regions: DataFrame) -> DataFrame:
    """Return (thread_id, band, region_ids): operational regions by band, in region order."""
    live = regions.where("persistence_state in ('active', 'background', 'unresolved')")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "region_id")))
    return live.groupBy("thread_id", "activation_band").agg(F.array_join(F.transform(listed, lambda x: x["region_id"]), ",").alias("region_ids"))


def incidence(regions: DataFrame, relations: DataFrame) -> DataFrame:
    """Return (thread_id, region_id, relation_ids): active relations of operational regions."""
    active = relations.where("lifecycle = 'active'")
    ends = active.select("thread_id", "ordinal", "relation_id", F.explode(F.array_distinct(F.array_compact(F.array("source_region_id", "target_region_id")))).alias("region_id"))
    live = regions.where("persistence_state in ('active', 'background', 'unresolved')").select("thread_id", "region_id")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "relation_id")))
    return ends.join(live, ["thread_id", "region_id"], "left_semi").groupBy("thread_id", "region_id").agg(F.array_join(F.transform(listed, lambda x: x["relation_id"]), ",").alias("relation_ids"))


def open_ends(regions: DataFrame, relations: DataFrame) -> DataFrame:
    """Return (thread_id, relation_id, region_id, fault) of endpoints that closure forbids."""
    ends = relations.select("thread_id", "relation_id", "lifecycle", F.explode(F.array_distinct(F.array_compact(F.array("source_region_id", "target_region_id")))).alias("region_id"))
    known = ends.join(regions.select("thread_id", "region_id", "persistence_state"), ["thread_id", "region_id"], "left")
    live = F.col("persistence_state").isin("active", "background", "unresolved")
    fault = F.when(F.col("persistence_state").isNull(), "endpoint missing").when((F.col("lifecycle") == "active") & ~live, "active relation endpoint")
    return known.select("thread_id", "relation_id", "region_id", fault.alias("fault")).where("fault is not null")


def excess(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Return (thread_id, kind, actual, maximum): the first exceeded bound of each thread."""
    kinds = list(limits)
    first = F.coalesce(*(F.when(F.col(k) > n, F.struct(F.lit(k).alias("kind"), F.col(k).alias("actual"), F.lit(n).cast("long").alias("maximum"))) for k, n in limits.items()))
    return counts.select("thread_id", *kinds).select("thread_id", first.alias("first")).where("first is not null").select("thread_id", "first.*")
