"""Measured execution: statuses, limits, coverage, packets and synthesis input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operation statuses; no match is not a failure.
STATUSES = ("completed", "completed_zero_matches", "truncated", "surface_unavailable", "failed")


def operation_status(available: Column, failed: Column, observed: Column, limit: Column) -> Column:
    """Status of an operation from what was measured."""
    return F.when(~available, "surface_unavailable").when(failed, "failed").when(observed == 0, "completed_zero_matches").when(observed > limit, "truncated").otherwise("completed")


def overall_status(operations: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Return (plan, status): failed if a required operation failed, partial if any fell short."""
    bad = F.col("status").isin("surface_unavailable", "failed")
    short = bad | (F.col("status") == "truncated")
    status = F.when(F.max((bad & F.col("required")).cast("int")) == 1, "failed").when(F.max(short.cast("int")) == 1, "partial").otherwise("complete")
    return operations.groupBy(plan).agg(status.alias("status"))


def execution_limits(operations: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Requested and completed operations, and the ids of those that failed."""
    bad = F.col("status").isin("surface_unavailable", "failed")

    def failed(required: bool) -> Column:
        chosen = F.when(bad & (F.col("required") if required else ~F.col("required")), F.col("operation_id"))
        return F.array_join(F.array_sort(F.collect_set(chosen)), ",")

    return operations.groupBy(plan).agg(F.count("*").alias("requested"), F.count(F.when(~bad, 1)).alias("completed"), failed(True).alias("failed_required"), failed(False).alias("failed_optional"))


def coverage_facts(operations: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Return (plan, fact, detail): what execution covered, one row a fact.

    ``operations`` has status, surface_id, exhaustive, depth, range_start and range_end.
    """
    done = F.col("status").isin("completed", "completed_zero_matches", "truncated")
    facts = [
        ("exhaustive_completed", done & F.col("exhaustive") & (F.col("status") != "truncated"), F.col("operation_id")),
        ("operation_completed", done, F.col("operation_id")),
        ("depth_reached", done & F.col("depth").isNotNull(), F.col("depth").cast("string")),
        ("cap_applied", F.col("status") == "truncated", F.col("operation_id")),
        ("surface_unavailable", F.col("status") == "surface_unavailable", F.col("surface_id")),
        ("range_covered", done & F.col("range_start").isNotNull(), F.concat_ws("..", "range_start", "range_end")),
    ]
    return reduce(DataFrame.unionByName, (operations.where(when).select(plan, F.lit(name).alias("fact"), detail.alias("detail")) for name, when, detail in facts))


def meets(facts: DataFrame, requirements: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Requirements (plan, fact, detail) with whether a fact meets them."""
    held = facts.select(plan, "fact", "detail", F.lit(True).alias("held")).distinct()
    return requirements.join(held, [plan, "fact", "detail"], "left").withColumn("met", F.coalesce("held", F.lit(False))).drop("held")


def requirements_met(operations: DataFrame, requirements: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Return (plan, requirement_id, met) of coverage requirements of the four kinds.

    ``requirements`` has kind and, by kind: ``exhaustive_exact`` surface_id,
    ``graph_depth`` depth, ``operations_completed`` operation_ids, ``temporal_range``
    range_start and range_end (either may be open). Not to have measured is not met.
    """
    done = operations.where(F.col("status").isin("completed", "completed_zero_matches", "truncated"))
    whole = done.where("exhaustive and status <> 'truncated'").select(plan, "surface_id").distinct().withColumn("whole", F.lit(True))
    reach = done.groupBy(plan).agg(F.max("depth").alias("reached"), F.min("range_start").alias("first"), F.max("range_end").alias("last"))
    asked = requirements.select(plan, "requirement_id", F.explode("operation_ids").alias("operation_id"))
    finished = asked.join(done.where("status <> 'truncated'").select(plan, "operation_id", F.lit(1).alias("one")).distinct(), [plan, "operation_id"], "left")
    complete = finished.groupBy(plan, "requirement_id").agg((F.count("one") == F.count("*")).alias("complete"))
    joined = requirements.join(whole, [plan, "surface_id"], "left").join(reach, plan, "left").join(complete, [plan, "requirement_id"], "left")
    within = (F.col("range_start").isNull() | (F.col("first") <= F.col("range_start"))) & (F.col("range_end").isNull() | (F.col("last") >= F.col("range_end"))) & F.col("first").isNotNull()
    kind = F.col("kind")
    met = F.when(kind == "exhaustive_exact", F.col("whole")).when(kind == "graph_depth", F.col("reached") >= F.col("required_depth")).when(kind == "operations_completed", F.col("complete")).when(kind == "temporal_range", within)
    return joined.select(plan, "requirement_id", F.coalesce(met, F.lit(False)).alias("met"))


def applied_statuses(operations: DataFrame) -> DataFrame:
    """Operations that a plan measured, with their statuses."""
    bound = F.coalesce("bound", F.lit(1 << 62))
    return operations.withColumn("status", operation_status(F.col("available"), F.col("failed"), F.col("observed"), bound))


def unit_payload(routes: DataFrame, units: DataFrame, assignments: DataFrame, occurrences: DataFrame, anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """Returned units with their content and what hangs on them.

    ``routes`` has (unit_id, operation_id, surface_id); identifiers and anchors are those of
    the unit's object, occurrences those that leave the unit, segments its transport parts.
    Lists of one unit are bounded by the note that it stands in; routes by the plan.
    """

    def listed(rows: DataFrame, key: str, text: Column, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(text)), ",").alias(name))

    found = listed(routes, "unit_id", F.concat_ws(":", "operation_id", F.coalesce("surface_id", F.lit("-"))), "provenance").join(units.select("unit_id", "object_id", "ordinal", "content"), "unit_id")
    found = found.join(listed(assignments, "object_id", F.concat_ws("=", "identifier_name", "value"), "identifiers"), "object_id", "left")
    found = found.join(listed(anchors, "object_id", F.col("value"), "anchors"), "object_id", "left")
    found = found.join(listed(occurrences.select(F.col("source_unit_id").alias("unit_id"), "occurrence_id"), "unit_id", F.col("occurrence_id"), "occurrences"), "unit_id", "left")
    parts = segments.groupBy("object_id", "ordinal").agg(F.count("*").alias("segments"))
    return found.join(parts, ["object_id", "ordinal"], "left").drop("ordinal")


def returned_units(routes: DataFrame) -> DataFrame:
    """One row a unit with all routes that returned it, in order."""
    listed = F.array_sort(F.collect_set(F.struct("operation_id", "surface_id")))
    return routes.groupBy("plan_id", "unit_id").agg(F.count("*").alias("routes"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["operation_id"], x["surface_id"])), ",").alias("provenance"))


def packet(units: DataFrame, order: list, overall: int, per_object: int, plan: str = "plan_id") -> DataFrame:
    """Keep units in rank order within bounds; the rest stays with the reason why it is out.

    Bounds count and rank only; meaning never removes a unit. ``units`` has plan,
    object_id and unit_id; kept units get a rank, which is cut before the shuffle, so
    that no task ranks all units of a plan.
    """
    in_object = F.row_number().over(Window.partitionBy(plan, "object_id").orderBy(*order))
    ranked = units.withColumn("object_rank", in_object.cast("long"))
    rank = F.row_number().over(Window.partitionBy(plan).orderBy(*order))
    kept = ranked.where(F.col("object_rank") <= per_object).withColumn("rank", rank).where(F.col("rank") <= overall)
    joined = ranked.join(kept.select(plan, "object_id", "unit_id", F.col("rank").cast("long").alias("rank")), [plan, "object_id", "unit_id"], "left")
    reason = F.when(F.col("object_rank") > per_object, "object_bound").when(F.col("rank").isNull(), "packet_bound")
    return joined.withColumn("removed_reason", reason)


def synthesis_input(turns: DataFrame, versions: DataFrame | None = None, plans: DataFrame | None = None, operations: DataFrame | None = None) -> DataFrame:
    """Turns with the previous turn, which a fresh thread does not have, and all that synthesis gets.

    ``versions`` (thread_id, k, state_version) are the accepted states, ``plans``
    (thread_id, k, plan_id) the plan of each turn, ``operations`` what plans measured: it
    gives the result's status and the execution limits. A turn without a plan has none.
    """
    before = Window.partitionBy("thread_id").orderBy("k")
    out = turns.select("thread_id", "k", F.col("text").alias("utterance"), F.lag("text").over(before).alias("previous_turn"))
    if versions is not None:
        out = out.join(versions, ["thread_id", "k"], "left")
    if plans is not None:
        out = out.join(plans, ["thread_id", "k"], "left")
    if operations is not None:
        out = out.join(overall_status(operations), "plan_id", "left").join(execution_limits(operations), "plan_id", "left")
    return out
