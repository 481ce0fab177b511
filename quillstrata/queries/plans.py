"""Plan queries: conformance, execution, measured coverage and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import traversal as T
from quillstrata.plans import access as X
from quillstrata.plans import report as Q
from quillstrata.queries.retrieval import _CONTEXTS
from quillstrata.queries.threads import _TURNS, log, turns
from quillstrata.sources import read_table


def snapshot(spark: SparkSession, sf_dir: str) -> X.Snapshot:
    """Parts, their occurrences in line items and the dated orders, as a snapshot."""
    lines, orders, part = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    records = part.select(F.lit("semantic_object").alias("kind"), F.col("p_partkey").cast("string").alias("id")).unionByName(orders.select(F.lit("temporal_anchor").alias("kind"), F.col("o_orderkey").cast("string").alias("id")))
    edges = T.edges(lines, "semantic_object", "l_partkey", "object_context", "temporal_anchor", "l_orderkey", "incoming")
    anchors = orders.select(F.lit("temporal_anchor").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("anchor"))
    units = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.col("text").alias("content"))
    return X.Snapshot(records, edges, units, anchors, {"object_context": ("semantic_object", ("incoming",), "temporal_anchor")}, {"exact": (("semantic_unit",), ("literal",), 32, True), "vector": (("semantic_unit",), ("nearest_neighbours",), 32, False)}, {"lang": ("semantic_unit",), "dated": ("temporal_anchor",)})


def _all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return read_table(spark, sf_dir, "part").select(key.alias("root"), F.lit("semantic_object").alias("kind"), key.alias("id"))


def _chronology(how: str) -> X.Plan:
    steps = (X.Follow("object_context", "incoming"), X.Temporal(how))
    return X.Plan((X.Binding("parts", "semantic_object", ()),), (X.Path("parts", steps, "found"),), (), (("anchors", "found"),))


@register("access_plan_earliest", f"SELECT part_key::VARCHAR AS root, 'temporal_anchor' AS kind, id, anchor FROM (SELECT part_key, order_key::VARCHAR AS id, anchor_date AS anchor, row_number() OVER (PARTITION BY part_key ORDER BY anchor_date, order_key::VARCHAR) AS k FROM ({_CONTEXTS})) WHERE k = 1")
def access_plan_earliest(spark, sf_dir):
    """The chronology as a typed plan: follow contexts of all parts, keep the earliest."""
    return X.execute(_chronology("earliest"), snapshot(spark, sf_dir), {"parts": _all_parts(spark, sf_dir)})["found"]


@register("access_plan_descending", f"SELECT part_key::VARCHAR AS root, 'temporal_anchor' AS kind, order_key::VARCHAR AS id, anchor_date AS anchor, row_number() OVER (PARTITION BY part_key ORDER BY anchor_date DESC, order_key::VARCHAR) AS position FROM ({_CONTEXTS})")
def access_plan_descending(spark, sf_dir):
    """All contexts of all parts, newest first."""
    return X.execute(_chronology("descending"), snapshot(spark, sf_dir), {"parts": _all_parts(spark, sf_dir)})["found"].select("root", "kind", "id", "anchor", "position")


@register("exact_total_output", "SELECT count(DISTINCT o_orderkey) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def exact_total_output(spark, sf_dir):
    """Exhaustive number of contexts that the plan reaches."""
    found = X.execute(_chronology("ascending"), snapshot(spark, sf_dir), {"parts": _all_parts(spark, sf_dir)})["found"]
    return X.shape(found, "exact_total")


@register("conformance_violations", """SELECT * FROM (VALUES ('missing_address', 'semantic_object:no such part'), ('missing_relation', 'sings'), ('unsupported_transition', 'object_song'), ('direction_unavailable', 'object_context'),
  ('surface_unavailable', 'vector'), ('input_type_mismatch', 'temporal:earliest'), ('configuration_bound_exceeded', 'exact'), ('missing_identifier', 'mood'), ('identifier_not_applicable', 'dated'), ('output_unavailable', 'nowhere'), ('unresolved_authored_target', 'Lost Book')) t(code, subject)""")
def conformance_violations(spark, sf_dir):
    """Faults of a plan made with one of each kind."""
    paths = [X.Path("parts", ops, f"p{k}") for k, ops in enumerate(((X.Follow("sings"),), (X.Follow("object_song"),), (X.Follow("object_context", "outgoing"),), (X.Search("vector", "nearest_neighbours", None),), (X.Temporal("earliest"),), (X.Search("exact", "literal", "a", 33),), (X.Search("exact", "literal", "a", 3, "mood"),), (X.Search("exact", "literal", "a", 3, "dated"),)))]
    plan = X.Plan((X.Binding("parts", "semantic_object", ("0", "no such part"), ("Lost Book",)),), tuple(paths), (), (("anchors", "p2"), ("units", "nowhere")))
    return X.conform(plan, snapshot(spark, sf_dir))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up measured operations: event types as plans, users as operations."""
    counts = read_table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("observed"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("range_start"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("range_end"))
    user = F.col("user_id")
    observed = F.when(user % 11 == 0, 0).otherwise(F.col("observed"))
    status = Q.operation_status(user % 7 != 0, user % 13 == 0, observed, F.lit(15))
    return counts.select(F.col("event_type").alias("plan_id"), F.concat(F.lit("op"), user).alias("operation_id"), status.alias("status"), (user % 3 == 0).alias("required"), F.concat(F.lit("s"), user % 4).alias("surface_id"), (user % 4 == 0).alias("exhaustive"), F.when(user % 5 == 0, user % 6).alias("depth"), "range_start", "range_end")


_OPS = """SELECT event_type AS plan_id, 'op' || user_id::VARCHAR AS operation_id,
  CASE WHEN user_id % 7 = 0 THEN 'surface_unavailable' WHEN user_id % 13 = 0 THEN 'failed' WHEN user_id % 11 = 0 THEN 'completed_zero_matches' WHEN count(*) > 15 THEN 'truncated' ELSE 'completed' END AS status,
  user_id % 3 = 0 AS required, 's' || (user_id % 4)::VARCHAR AS surface_id, user_id % 4 = 0 AS exhaustive, CASE WHEN user_id % 5 = 0 THEN user_id % 6 END AS depth,
  strftime(min(ts), '%Y-%m-%d') AS range_start, strftime(max(ts), '%Y-%m-%d') AS range_end FROM events GROUP BY event_type, user_id"""
_BAD = "status IN ('surface_unavailable', 'failed')"
_DONE = f"NOT {_BAD}"


@register("operation_status", f"SELECT plan_id, operation_id, status FROM ({_OPS})")
def operation_status(spark, sf_dir):
    """Status of every operation."""
    return operations(spark, sf_dir).select("plan_id", "operation_id", "status")


@register("execution_status", f"SELECT plan_id, CASE WHEN bool_or({_BAD} AND required) THEN 'failed' WHEN bool_or({_BAD} OR status = 'truncated') THEN 'partial' ELSE 'complete' END AS status FROM ({_OPS}) GROUP BY plan_id")
def execution_status(spark, sf_dir):
    """Status of every plan."""
    return Q.overall_status(operations(spark, sf_dir))


@register("execution_limits", f"SELECT plan_id, count(*) AS requested, count(*) FILTER ({_DONE}) AS completed, coalesce(string_agg(operation_id, ',' ORDER BY operation_id) FILTER ({_BAD} AND required), '') AS failed_required, coalesce(string_agg(operation_id, ',' ORDER BY operation_id) FILTER ({_BAD} AND NOT required), '') AS failed_optional FROM ({_OPS}) GROUP BY plan_id")
def execution_limits(spark, sf_dir):
    """Requested and completed operations of every plan."""
    return Q.execution_limits(operations(spark, sf_dir))


_FACTS = f"""SELECT plan_id, 'exhaustive_completed' AS fact, operation_id AS detail FROM o WHERE {_DONE} AND exhaustive AND status <> 'truncated'
  UNION ALL SELECT plan_id, 'operation_completed', operation_id FROM o WHERE {_DONE} UNION ALL SELECT plan_id, 'depth_reached', depth::VARCHAR FROM o WHERE {_DONE} AND depth IS NOT NULL
  UNION ALL SELECT plan_id, 'cap_applied', operation_id FROM o WHERE status = 'truncated' UNION ALL SELECT plan_id, 'surface_unavailable', surface_id FROM o WHERE status = 'surface_unavailable'
  UNION ALL SELECT plan_id, 'range_covered', range_start || '..' || range_end FROM o WHERE {_DONE}"""


@register("coverage_facts", f"WITH o AS ({_OPS}) {_FACTS}")
def coverage_facts(spark, sf_dir):
    """What every plan covered."""
    return Q.coverage_facts(operations(spark, sf_dir))


@register("coverage_requirements", f"WITH o AS ({_OPS}), f AS ({_FACTS}) SELECT plan_id, 'exhaustive_completed' AS fact, operation_id AS detail, (plan_id, operation_id) IN (SELECT (plan_id, detail) FROM f WHERE fact = 'exhaustive_completed') AS met FROM o WHERE exhaustive")
def coverage_requirements(spark, sf_dir):
    """Whether each exhaustive operation was completed."""
    ops = operations(spark, sf_dir)
    wanted = ops.where("exhaustive").select("plan_id", F.lit("exhaustive_completed").alias("fact"), F.col("operation_id").alias("detail"))
    return Q.meets(Q.coverage_facts(ops), wanted)


@register("returned_units", "SELECT o_orderpriority AS plan_id, l_partkey::VARCHAR AS unit_id, count(*) AS routes, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, ',' ORDER BY l_returnflag || ':' || l_linestatus) AS provenance FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def returned_units(spark, sf_dir):
    """Parts that each priority's orders return, with all routes."""
    lines, orders = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return Q.returned_units(rows.select(F.col("o_orderpriority").alias("plan_id"), F.col("l_partkey").cast("string").alias("unit_id"), F.col("l_returnflag").alias("operation_id"), F.col("l_linestatus").alias("surface_id")))


@register("packet_bounded", """SELECT plan_id, object_id, unit_id, object_rank, CASE WHEN within AND rank <= 50 THEN rank END AS rank, CASE WHEN NOT within THEN 'object_bound' WHEN rank > 50 THEN 'packet_bound' END AS removed_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id, within ORDER BY unit_id) AS rank FROM (SELECT *, object_rank <= 2 AS within FROM (
    SELECT event_type AS plan_id, user_id AS object_id, event_id AS unit_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS object_rank FROM events)))""")
def packet_bounded(spark, sf_dir):
    """Events as units: fifty of a plan, two of an object; the rest keeps its reason."""
    events = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("plan_id"), F.col("user_id").alias("object_id"), F.col("event_id").alias("unit_id"))
    return Q.packet(events, ["unit_id"], 50, 2)


_NEEDS = """SELECT plan_id, 'exact' AS requirement_id, 'exhaustive_exact' AS kind, 's0' AS surface_id, NULL::INT AS required_depth, NULL AS wanted, NULL AS range_start, NULL AS range_end FROM o GROUP BY plan_id
  UNION ALL SELECT plan_id, 'depth', 'graph_depth', NULL, 5, NULL, NULL, NULL FROM o GROUP BY plan_id UNION ALL SELECT plan_id, 'deeper', 'graph_depth', NULL, 6, NULL, NULL, NULL FROM o GROUP BY plan_id
  UNION ALL SELECT plan_id, 'done', 'operations_completed', NULL, NULL, min(operation_id) FILTER (status LIKE 'completed%'), NULL, NULL FROM o GROUP BY plan_id UNION ALL SELECT plan_id, 'undone', 'operations_completed', NULL, NULL, min(operation_id) FILTER (status = 'failed'), NULL, NULL FROM o GROUP BY plan_id
  UNION ALL SELECT plan_id, 'range', 'temporal_range', NULL, NULL, NULL, min(range_start), NULL FROM o GROUP BY plan_id"""


@register("coverage_requirement_kinds", f"""WITH o AS ({_OPS}), q AS ({_NEEDS}) SELECT plan_id, requirement_id, coalesce(CASE kind WHEN 'exhaustive_exact' THEN (SELECT bool_or(status LIKE 'completed%') FROM o WHERE o.plan_id = q.plan_id AND o.surface_id = q.surface_id AND exhaustive)
  WHEN 'graph_depth' THEN (SELECT max(depth) FROM o WHERE o.plan_id = q.plan_id AND {_DONE}) >= required_depth WHEN 'operations_completed' THEN (SELECT bool_and(status LIKE 'completed%') FROM o WHERE o.plan_id = q.plan_id AND operation_id = wanted)
  ELSE (SELECT min(range_start) FROM o WHERE o.plan_id = q.plan_id AND {_DONE}) <= range_start END, false) AS met FROM q""")
def coverage_requirement_kinds(spark, sf_dir):
    """Requirements of all four kinds, two of them twice."""
    ops = operations(spark, sf_dir)
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("int")
    by_plan = ops.groupBy("plan_id").agg(F.min(F.when(F.col("status").startswith("completed"), F.col("operation_id"))).alias("done"), F.min(F.when(F.col("status") == "failed", F.col("operation_id"))).alias("undone"), F.min("range_start").alias("first"))

    def need(name: str, kind: str, surface=text, depth=whole, ids=None, start=text):
        return F.struct(F.lit(name).alias("requirement_id"), F.lit(kind).alias("kind"), surface.alias("surface_id"), depth.alias("required_depth"), (F.array(ids) if ids is not None else F.lit(None).cast("array<string>")).alias("operation_ids"), start.alias("range_start"), text.alias("range_end"))

    needs = [need("exact", "exhaustive_exact", surface=F.lit("s0")), need("depth", "graph_depth", depth=F.lit(5)), need("deeper", "graph_depth", depth=F.lit(6)), need("done", "operations_completed", ids=F.col("done")), need("undone", "operations_completed", ids=F.col("undone")), need("range", "temporal_range", start=F.col("first"))]
    return Q.requirements_met(ops, by_plan.select("plan_id", F.inline(F.array(*needs))))


@register("synthesis_input", f"SELECT thread_id, k, text AS utterance, lag(text) OVER (PARTITION BY thread_id ORDER BY k) AS previous_turn FROM ({_TURNS})")
def synthesis_input(spark, sf_dir):
    """What synthesis gets of every turn."""
    return Q.synthesis_input(turns(spark, sf_dir))


@register("synthesis_complete", f"""WITH o AS ({_OPS}), p AS (SELECT plan_id, row_number() OVER (ORDER BY plan_id) - 1 AS place FROM (SELECT DISTINCT plan_id FROM o)),
  r AS (SELECT plan_id, CASE WHEN bool_or({_BAD} AND required) THEN 'failed' WHEN bool_or({_BAD} OR status = 'truncated') THEN 'partial' ELSE 'complete' END AS status, count(*) AS requested, count(*) FILTER ({_DONE}) AS completed FROM o GROUP BY plan_id)
  SELECT thread_id, k, text AS utterance, lag(text) OVER (PARTITION BY thread_id ORDER BY k) AS previous_turn, k + 1 AS state_version, p.plan_id, r.status, r.requested, r.completed FROM ({_TURNS}) t LEFT JOIN p ON p.place = t.k % 7 LEFT JOIN r ON r.plan_id = p.plan_id""")
def synthesis_complete(spark, sf_dir):
    """What synthesis gets of every turn: state, plan, result and limits; two turns of seven have no plan."""
    ops = operations(spark, sf_dir)
    versions = log(spark, sf_dir).select("thread_id", F.col("ordinal").alias("k"), F.col("sequence").alias("state_version"))
    names = ops.select("plan_id").distinct().agg(F.array_sort(F.collect_list("plan_id")).alias("names"))
    place = (F.col("k") % 7).cast("int")
    plans = turns(spark, sf_dir).crossJoin(F.broadcast(names)).select("thread_id", "k", F.get("names", place).alias("plan_id"))
    whole = Q.synthesis_input(turns(spark, sf_dir), versions, plans, ops)
    return whole.select("thread_id", "k", "utterance", "previous_turn", "state_version", "plan_id", "status", "requested", "completed")
