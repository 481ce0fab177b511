"""Fold queries over scripted threads.

Every customer is a thread that has accepted the first contributions of one script,
which merges, splits, retires, replaces, supersedes, abandons, preserves and releases.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import fold
from quillstrata.sources import read_table, spread


def _region(identity: str, **more: object) -> dict:
    base = {"region_id": identity, "anchor_referents": [], "relation_ids": ["stale"], "local_constraint_ids": [], "open_tension_ids": [], "source_contribution_ids": [], "persistence_state": "active", "activation_band": "primary", "supersedes_region_id": None}
    return base | more


def _referent(identity: str, k: int) -> dict:
    return {"referent_id": identity, "expression": "x", "source_contribution_id": f"c{k}"}


def _connect(identity: str, k: int, a: str, b: str) -> dict:
    return {"operation": "connect", "relation": {"relation_id": identity, "source_region_id": a, "relation_type": {"kind": "temporal"}, "target_region_id": b, "source_contribution_id": f"c{k}", "lifecycle": "active"}}


def _constraint(identity: str, k: int, *targets: str) -> dict:
    where = {"kind": "regions", "region_ids": list(targets)} if targets else {"kind": "whole_problem_space"}
    return {"constraint_id": identity, "expression": "x", "applicability": where, "source_contribution_id": f"c{k}", "lifecycle": "active"}


def _open(identity: str, k: int, region: str) -> dict:
    return {"operation": "open", "tension": {"tension_id": identity, "region_id": region, "tension_type": {"kind": "contradiction"}, "unresolved_expression": None, "candidate_bindings": [], "source_turn_id": f"t{k}", "lifecycle": "open"}}


def _release(kind: str, identity: str, mode: str) -> dict:
    return {"subject": {"kind": kind, "id": identity}, "mode": mode, "reason": "x"}


def _preserve(kind: str, identity: str) -> dict:
    return {"subject": {"kind": kind, "id": identity}, "reason": "x"}


_WHY = {"reason": "x"}
_R, _L, _C, _T, _A, _P, _E = fold.LISTS
#: Contributions in order; list k is what contribution k declares.
SCRIPT: list[dict] = [
    {_R: [{"operation": "create", "region": _region("r1", anchor_referents=[_referent("x1", 0)])}, {"operation": "create", "region": _region("r2")}, {"operation": "create", "region": _region("r3")}], _L: [_connect("rel1", 0, "r1", "r2")], _C: [{"operation": "add", "constraint": _constraint("con1", 0)}], _T: [_open("ten1", 0, "r1")]},
    {_R: [{"operation": "extend", "region_id": "r1", "referent": _referent("x2", 1)}, {"operation": "preserve", "region_id": "r2"} | _WHY], _A: [{"region_id": "r2", "band": "secondary"}], _P: [_preserve("relation", "rel1"), _preserve("referent", "x1")]},
    {_L: [{"operation": "disconnect", "relation_id": "rel1"} | _WHY], _T: [{"operation": "resolve", "tension_id": "ten1", "resolution": "x"}], _E: [_release("relation", "rel1", "retire")]},
    {_R: [{"operation": "merge", "source_region_ids": ["r1", "r2"], "resulting_region": _region("r4")} | _WHY], _E: [_release("region", "r1", "supersede"), _release("referent", "x2", "abandon")]},
    {_R: [{"operation": "split", "source_region_id": "r3", "resulting_regions": [_region("r5", supersedes_region_id="r3"), _region("r6", supersedes_region_id="r3", activation_band="tertiary")]} | _WHY]},
    {_C: [{"operation": "add", "constraint": _constraint("con2", 5, "r4", "r5")}], _T: [_open("ten2", 5, "r4"), _open("ten3", 5, "r5")]},
    {_C: [{"operation": "replace", "prior_constraint_id": "con1", "replacement": _constraint("con3", 6)} | _WHY], _T: [{"operation": "supersede", "tension_id": "ten2", "superseded_by_tension_id": "ten3"} | _WHY], _E: [_release("constraint", "con1", "supersede"), _release("open_tension", "ten2", "supersede")]},
    {_C: [{"operation": "retire", "constraint_id": "con2"} | _WHY], _T: [{"operation": "abandon", "tension_id": "ten3"} | _WHY], _E: [_release("open_tension", "ten3", "abandon"), _release("constraint", "con2", "retire")]},
    {_R: [{"operation": "supersede", "region_id": "r5", "superseded_by_region_id": "r4"} | _WHY], _P: [_preserve("region", "r4"), _preserve("constraint", "con3")]},
    {_R: [{"operation": "retire", "region_id": "r4"} | _WHY], _E: [_release("region", "r4", "retire")]},
    {_R: [{"operation": "create", "region": _region("r7", persistence_state="background", activation_band="background")}, {"operation": "reinforce", "region_id": "r6"} | _WHY], _A: [{"region_id": "r6", "band": "secondary"}]},
    {_L: [_connect("rel2", 11, "r6", "r7")], _T: [_open("ten4", 11, "r7")], _C: [{"operation": "add", "constraint": _constraint("con4", 11, "r7")}]},
    {},
]


def _contribution(k: int, lists: dict) -> dict:
    return {"contribution_id": f"c{k}", "source_turn_id": f"t{k}", "source_utterance_id": f"u{k}"} | {x: [] for x in fold.LISTS} | lists


def _log_rows(spark: SparkSession, scripts: dict[str, list[dict]]) -> DataFrame:
    rows = [(name, k, k + 1, k, json.dumps(c)) for name, contributions in scripts.items() for k, c in enumerate(contributions)]
    return spark.createDataFrame(rows, "name string, ordinal long, sequence long, prior_state_version long, contribution string")


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of every customer: the first contributions of the script, one to all of them."""
    script = _log_rows(spark, {"all": [_contribution(k, x) for k, x in enumerate(SCRIPT)]})
    threads = spread(read_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("string").alias("thread_id"), (F.col("c_custkey") % len(SCRIPT)).alias("last"))
    return threads.join(F.broadcast(script), F.col("ordinal") <= F.col("last")).drop("name", "last")


_THREADS = f"SELECT c_custkey::VARCHAR AS thread_id, c_custkey % {len(SCRIPT)} AS last FROM customer"
_STATE = "regions array<struct<region_id:string, persistence_state:string, relation_ids:array<string>, local_constraint_ids:array<string>, open_tension_ids:array<string>>>, relations array<struct<relation_id:string, lifecycle:string>>, constraints array<struct<constraint_id:string, lifecycle:string>>, open_tensions array<struct<tension_id:string, lifecycle:string>>, attention_lens struct<primary_region_ids:array<string>, secondary_region_ids:array<string>, tertiary_region_ids:array<string>, background_region_ids:array<string>>, contribution_history array<struct<contribution_id:string, transformations:array<string>>>"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.replay_threads(scripted(spark, sf_dir)).select("thread_id", F.from_json("state", _STATE).alias("s"))


# What each record has become, by the contribution that made it so: (record, contribution, lifecycle).
_BECOMES = [
    *(("region", f"r{n}", 0, "active") for n in (1, 2, 3)), ("region", "r1", 3, "superseded"), ("region", "r2", 3, "superseded"), ("region", "r4", 3, "active"), ("region", "r3", 4, "superseded"),
    ("region", "r5", 4, "active"), ("region", "r6", 4, "active"), ("region", "r5", 8, "superseded"), ("region", "r4", 9, "retired"), ("region", "r7", 10, "background"),
    ("relation", "rel1", 0, "active"), ("relation", "rel1", 2, "retired"), ("relation", "rel2", 11, "active"),
    ("constraint", "con1", 0, "active"), ("constraint", "con2", 5, "active"), ("constraint", "con1", 6, "superseded"), ("constraint", "con3", 6, "active"), ("constraint", "con2", 7, "retired"), ("constraint", "con4", 11, "active"),
    ("tension", "ten1", 0, "open"), ("tension", "ten1", 2, "resolved"), ("tension", "ten2", 5, "open"), ("tension", "ten3", 5, "open"), ("tension", "ten2", 6, "superseded"), ("tension", "ten3", 7, "abandoned"), ("tension", "ten4", 11, "open"),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


@register("fold_lifecycles", f"SELECT thread_id, family, id, arg_max(lifecycle, k) AS lifecycle FROM ({_THREADS}) JOIN (VALUES {_values(_BECOMES)}) b(family, id, k, lifecycle) ON k <= last GROUP BY thread_id, family, id")
def fold_lifecycles(spark, sf_dir):
    """What every record of every thread has become."""
    families = {"region": ("regions", "region_id", "persistence_state"), "relation": ("relations", "relation_id", "lifecycle"), "constraint": ("constraints", "constraint_id", "lifecycle"), "tension": ("open_tensions", "tension_id", "lifecycle")}

    def listed(family: str, field: str, key: str, life: str) -> Column:
        return F.transform(f"s.{field}", lambda x: F.struct(F.lit(family).alias("family"), x[key].alias("id"), x[life].alias("lifecycle")))

    arrays = [listed(family, *names) for family, names in families.items()]
    return _states(spark, sf_dir).select("thread_id", F.inline(F.concat(*arrays)))


# What hangs on each operational region while it does: (region, list, id, from contribution, before contribution).
_HANGS = [("r1", "relation", "rel1", 0, 2), ("r2", "relation", "rel1", 0, 2), ("r6", "relation", "rel2", 11, 99), ("r7", "relation", "rel2", 11, 99), ("r4", "constraint", "con2", 5, 7), ("r5", "constraint", "con2", 5, 7), ("r7", "constraint", "con4", 11, 99), ("r1", "tension", "ten1", 0, 2), ("r4", "tension", "ten2", 5, 6), ("r5", "tension", "ten3", 5, 7), ("r7", "tension", "ten4", 11, 99)]


@register("fold_incidence", f"SELECT thread_id, region_id, family, id FROM ({_THREADS}) JOIN (VALUES {_values(_HANGS)}) h(region_id, family, id, since, until) ON since <= last AND last < until")
def fold_incidence(spark, sf_dir):
    """Derived indexes of operational regions; what was declared in them is void."""
    lists = {"relation": "relation_ids", "constraint": "local_constraint_ids", "tension": "open_tension_ids"}
    region = _states(spark, sf_dir).select("thread_id", F.inline("s.regions")).where(F.col("persistence_state").isin(*fold.OPERATIONAL))

    def listed(family: str, field: str) -> Column:
        return F.transform(field, lambda x: F.struct(F.lit(family).alias("family"), x.alias("id")))

    arrays = [listed(*names) for names in lists.items()]
    return region.select("thread_id", "region_id", F.inline(F.concat(*arrays)))


# The lens after each contribution: (contribution, band, regions).
_LENS = [(0, "primary", "r1,r2,r3"), *((k, "primary", "r1,r3") for k in (1, 2)), *((k, "secondary", "r2") for k in (1, 2)), (3, "primary", "r3,r4"), *((k, "primary", "r4,r5") for k in (4, 5, 6, 7)), (8, "primary", "r4"), *((k, "tertiary", "r6") for k in range(4, 10)), *((k, "secondary", "r6") for k in (10, 11, 12)), *((k, "background", "r7") for k in (10, 11, 12))]


@register("fold_lens", f"SELECT thread_id, band, regions FROM ({_THREADS}) JOIN (VALUES {_values(_LENS)}) l(k, band, regions) ON k = last")
def fold_lens(spark, sf_dir):
    """Operational regions by band, in order."""
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.array_join(F.col(f"s.attention_lens.{b}_region_ids"), ",").alias("regions")) for b in fold.BANDS))
    return _states(spark, sf_dir).select("thread_id", F.inline(bands)).where("regions <> ''")


_HISTORY = ["create,relate,constrain,tension", "preserve,extend,redirect_attention", "relate,tension,retire", "merge,supersede,retire", "split,supersede", "constrain,tension", "constrain,tension,supersede", "constrain,tension,retire", "preserve,supersede", "retire", "create,reinforce,redirect_attention", "relate,constrain,tension", ""]


@register("fold_history", f"SELECT thread_id, k::BIGINT AS k, transformations FROM ({_THREADS}) JOIN (VALUES {_values(list(enumerate(_HISTORY)))}) h(k, transformations) ON k <= last")
def fold_history(spark, sf_dir):
    """Categories of all accepted contributions, in canonical order."""
    rows = _states(spark, sf_dir).select("thread_id", F.inline("s.contribution_history"))
    return rows.select("thread_id", F.substring("contribution_id", 2, 9).cast("long").alias("k"), F.array_join("transformations", ",").alias("transformations"))


def _created(identity: str, **more: object) -> dict:
    return {"operation": "create", "region": _region(identity, **more)}


#: Contributions that follow the first two of the script and break one rule each: (case, code, lists).
_FAULTY = [
    ("attention of a missing region", "missing_referenced_record", {_A: [{"region_id": "z", "band": "primary"}]}),
    ("attention twice", "invalid_attention_assignment", {_A: [{"region_id": "r1", "band": "primary"}] * 2}),
    ("constraint on a missing region", "missing_referenced_record", {_C: [{"operation": "add", "constraint": _constraint("m", 2, "z")}]}),
    ("constraint on one region twice", "invalid_constraint_applicability", {_C: [{"operation": "add", "constraint": _constraint("m", 2, "r1", "r1")}]}),
    ("created twice", "record_identity_already_present", {_R: [_created("r1")]}),
    ("created terminal", "invalid_record_lifecycle", {_R: [_created("z", persistence_state="retired")]}),
    ("disconnected twice", "contradictory_terminal_operations", {_L: [{"operation": "disconnect", "relation_id": "rel1"} | _WHY] * 2}),
    ("empty identity", "empty_required_identity", {_R: [{"operation": "reinforce", "region_id": ""} | _WHY]}),
    ("end of an active relation retired", "final_referential_integrity_failure", {_R: [{"operation": "retire", "region_id": "r2"} | _WHY]}),
    ("merge of one", "invalid_merge_shape", {_R: [{"operation": "merge", "source_region_ids": ["r1"], "resulting_region": _region("z")} | _WHY]}),
    ("preserved and released", "invalid_preservation_declaration", {_P: [_preserve("region", "r1")], _E: [_release("region", "r1", "retire")]}),
    ("released but active", "invalid_release_declaration", {_E: [_release("region", "r1", "retire")]}),
    ("release mode of another kind", "unsupported_subject_release_mode_combination", {_E: [_release("relation", "rel1", "abandon")]}),
    ("replaced by a known one", "record_identity_already_present", {_C: [{"operation": "replace", "prior_constraint_id": "con1", "replacement": _constraint("con1", 2)} | _WHY]}),
    ("split in one", "invalid_split_shape", {_R: [{"operation": "split", "source_region_id": "r3", "resulting_regions": [_region("z", supersedes_region_id="r3")]} | _WHY]}),
    ("superseded by itself", "invalid_supersession", {_R: [{"operation": "supersede", "region_id": "r3", "superseded_by_region_id": "r3"} | _WHY]}),
    ("tension of another turn", "invalid_record_lifecycle", {_T: [_open("z", 1, "r1")]}),
    ("tension superseded by itself", "invalid_supersession", {_T: [{"operation": "supersede", "tension_id": "ten1", "superseded_by_tension_id": "ten1"} | _WHY]}),
    ("tension resolved and abandoned", "contradictory_terminal_operations", {_T: [{"operation": "resolve", "tension_id": "ten1", "resolution": "x"}, {"operation": "abandon", "tension_id": "ten1"} | _WHY]}),
    ("too many declarations", "contribution_declaration_count_excess", {_R: [{"operation": "reinforce", "region_id": "r1"} | _WHY] * 21}),
]


@register("fold_violations", f"SELECT name || ' #' || n_nationkey::VARCHAR AS thread_id, code FROM nation, (VALUES {_values([x[:2] for x in _FAULTY])}) f(name, code)")
def fold_violations(spark, sf_dir):
    """The rule that each faulty thread breaks; every case is a thread of every nation."""
    base = [_contribution(k, SCRIPT[k]) for k in (0, 1)]
    cases = _log_rows(spark, {name: [*base, _contribution(2, lists)] for name, _, lists in _FAULTY})
    threads = read_table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(cases))
    log = threads.withColumn("thread_id", F.concat("name", F.lit(" #"), F.col("n_nationkey").cast("string")))
    return fold.replay_threads(log, fold.Limits(20, 20, 20, 20, 20)).select("thread_id", F.col("violation.code").alias("code"))


@register("fold_continued", f"SELECT thread_id, last + 1 AS version, true AS same FROM ({_THREADS})")
def fold_continued(spark, sf_dir):
    """Incremental folding of each thread against a replay of its log written as JSON and read again."""
    return fold.restart_threads(scripted(spark, sf_dir)).select("thread_id", "version", "same")
