"""Typed access plans: conformance to a snapshot, and lazy execution.

A plan is a graph of bindings, paths and joins. ``conform`` checks it against the
snapshot's catalogues before anything runs; ``execute`` walks it in topological
order and gives one lazy DataFrame a binding, so that Spark plans the whole; ``run``
executes each operation once, in the same order, and measures it while it runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillstrata.operators import surfaces as R
from quillstrata.operators import traversal as T
from quillstrata.sources import Scratch

#: The violation codes of conformance.
CODES = (
    "missing_address",
    "missing_identifier",
    "identifier_not_applicable",
    "missing_relation",
    "direction_unavailable",
    "surface_unavailable",
    "input_type_mismatch",
    "output_unavailable",
    "configuration_bound_exceeded",
    "unresolved_authored_target",
    "unsupported_transition",
)
SHAPES = ("units", "object_ids", "unit_ids", "regions", "occurrence_paths", "anchors", "grouped_by_object", "ordered_evidence", "exact_total", "surface_provenance")
JOINS = ("group", "concatenate", "temporal_order")


@dataclass(frozen=True)
class Follow:
    """Follow a transition in a direction."""

    transition: str
    direction: str = "outgoing"
    required: bool = True


@dataclass(frozen=True)
class Search:
    """Search a surface in a match mode, in the scope of the input if there is one."""

    surface: str
    mode: str
    query: object
    limit: int | None = None
    identifier: str | None = None
    required: bool = True


@dataclass(frozen=True)
class Hydrate:
    """Turn found records into canonical units."""

    required: bool = True


@dataclass(frozen=True)
class Temporal:
    """Order anchors, group them, or keep the first or last of each binding."""

    how: str
    required: bool = True


@dataclass(frozen=True)
class Binding:
    """A named start set of one kind: addresses, and authored names to resolve."""

    name: str
    kind: str
    ids: tuple[str, ...]
    authored: tuple[str, ...] = ()


@dataclass(frozen=True)
class Path:
    """Operations from one binding to another."""

    start: str
    operations: tuple
    output: str


@dataclass(frozen=True)
class Join:
    """Branches put together."""

    how: str
    inputs: tuple[str, ...]
    output: str


@dataclass(frozen=True)
class Plan:
    """Bindings, paths, joins and outputs (shape, binding)."""

    bindings: tuple[Binding, ...]
    paths: tuple[Path, ...] = ()
    joins: tuple[Join, ...] = ()
    outputs: tuple[tuple[str, str], ...] = ()


@dataclass
class Snapshot:
    """Tables of a projection, and its small catalogues.

    records (kind, id), edges, units (unit_id, content), anchors (kind, id,
    anchor); transitions by id: (from kind, directions, to kind); surfaces by id:
    (kinds, modes, hard limit, available); identifiers by name: kinds; search
    functions by surface; ids by authored name, ambiguous names left out.
    """

    records: DataFrame
    edges: DataFrame
    units: DataFrame
    anchors: DataFrame
    transitions: dict[str, tuple[str, tuple[str, ...], str]]
    surfaces: dict[str, tuple[tuple[str, ...], tuple[str, ...], int, bool]]
    identifiers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    search: dict[str, Callable[[DataFrame, object], DataFrame]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)


def order(plan: Plan) -> list[Path | Join]:
    """Paths and joins in an order in which every input exists; a cycle is an error."""
    steps = {x.output: x for x in (*plan.paths, *plan.joins)}
    needs = {x.output: {x.start} if isinstance(x, Path) else set(x.inputs) for x in steps.values()}
    try:
        return [steps[name] for name in TopologicalSorter(needs).static_order() if name in steps]
    except CycleError as loop:
        raise ValueError(f"plan has a cycle: {loop.args[1]}") from loop


def _step_faults(op: object, kind: str, snapshot: Snapshot) -> tuple[list[tuple[str, str]], str]:
    """Faults of one operation on records of a kind, and the kind that comes out."""
    if isinstance(op, Follow):
        if op.transition not in snapshot.transitions:
            # Names begin with the kind they leave: from a kind of the catalogue the transition is unsupported,
            # from any other there is no such relation.
            leaves = {source.rpartition("_")[2] for source, _, _ in snapshot.transitions.values()}
            return [("unsupported_transition" if re.split("[-_]", op.transition)[0] in leaves else "missing_relation", op.transition)], kind
        source, directions, target = snapshot.transitions[op.transition]
        faults = [("input_type_mismatch", op.transition)] * (source != kind)
        faults += [("direction_unavailable", op.transition)] * (op.direction not in directions)
        return faults, target
    if isinstance(op, Search):
        kinds, modes, hard, available = snapshot.surfaces.get(op.surface, ((), (), 0, False))
        if not available or op.mode not in modes:
            return [("surface_unavailable", op.surface)], kind
        faults = [("configuration_bound_exceeded", op.surface)] * (op.limit is not None and op.limit > hard)
        if op.identifier is not None:
            if op.identifier not in snapshot.identifiers:
                faults.append(("missing_identifier", op.identifier))
            elif not set(snapshot.identifiers[op.identifier]) & set(kinds):
                faults.append(("identifier_not_applicable", op.identifier))
        return faults, kinds[0]
    if isinstance(op, Hydrate):
        return [("input_type_mismatch", "hydrate")] * (kind not in ("semantic_unit", "occurrence", "semantic_object")), "semantic_unit"
    return [("input_type_mismatch", f"temporal:{op.how}")] * (kind != "temporal_anchor"), kind


def conform(plan: Plan, snapshot: Snapshot, start: dict[str, DataFrame] | None = None) -> DataFrame:
    """Return (code, subject): everything in the plan that the snapshot does not have.

    Addresses, those of the plan and those that ``start`` gives as tables, are checked by
    an anti join, the rest against the catalogues; an empty table means that the plan is
    valid.
    """
    spark = snapshot.records.sparkSession
    kinds = {b.name: b.kind for b in plan.bindings}
    faults: list[tuple[str, str]] = [("unresolved_authored_target", x) for b in plan.bindings for x in b.authored if x not in snapshot.names]
    for step in order(plan):
        if isinstance(step, Join):
            missing = [x for x in step.inputs if x not in kinds]
            faults += [("output_unavailable", x) for x in missing]
            kinds[step.output] = kinds.get(step.inputs[0], "semantic_unit")
            continue
        if step.start not in kinds:
            faults.append(("output_unavailable", step.start))
            continue
        kind = kinds[step.start]
        for op in step.operations:
            found, kind = _step_faults(op, kind, snapshot)
            faults += found
        kinds[step.output] = kind
    faults += [("output_unavailable", name) for shape, name in plan.outputs if name not in kinds or shape not in SHAPES]
    listed = spark.createDataFrame(faults, "code string, subject string")
    named = [x for x in (start_sets(plan, snapshot), *(start or {}).values()) if x is not None]
    if not named:
        return listed
    asked = reduce(DataFrame.unionByName, (x.select("kind", "id") for x in named))
    absent = asked.join(snapshot.records, ["kind", "id"], "left_anti").where("id is not null")
    return listed.unionByName(absent.select(F.lit("missing_address").alias("code"), F.concat_ws(":", "kind", "id").alias("subject")))


def start_sets(plan: Plan, snapshot: Snapshot) -> DataFrame | None:
    """The addresses that the plan itself names, as (root, kind, id)."""
    rows = [(b.name, b.kind, x) for b in plan.bindings for x in (*b.ids, *(snapshot.names[n] for n in b.authored if n in snapshot.names))]
    return snapshot.records.sparkSession.createDataFrame(rows, "root string, kind string, id string") if rows else None


@dataclass
class Execution:
    """Rows of each binding, and what each operation measured."""

    bindings: dict[str, DataFrame]
    operations: DataFrame


OPERATIONS = "operation_id string, kind string, surface_id string, required boolean, observed long, bound long, available boolean, failed boolean"
#: Rows of one operation, given the operation, its number in the plan and its input.
Step = Callable[[object, str, DataFrame], DataFrame]
#: Rows with their position in a group, given the group and the order.
Ordered = Callable[[DataFrame, str, list], DataFrame]


def _walk(plan: Plan, snapshot: Snapshot, start: dict[str, DataFrame] | None, step: Step, ordered: Ordered = T.temporal_order) -> dict[str, DataFrame]:
    """Rows of every binding; operations are numbered from 1 along each path, as ``output.number``."""
    out = dict(start or {})
    named = start_sets(plan, snapshot)
    for b in plan.bindings:
        if b.name not in out:
            out[b.name] = named.where(F.col("root") == b.name).select(F.col("id").alias("root"), "kind", "id")
    for part in order(plan):
        if isinstance(part, Join):
            branches = {x: out[x] for x in part.inputs}
            joined = T.group_branches(branches) if part.how == "group" else T.concatenate(branches)
            out[part.output] = ordered(joined, "root", ["anchor", "id"]) if part.how == "temporal_order" else joined
            continue
        rows = out[part.start]
        for number, op in enumerate(part.operations, 1):
            rows = step(op, f"{part.output}.{number}", rows)
        out[part.output] = rows
    return out


def execute(plan: Plan, snapshot: Snapshot, start: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Return one lazy DataFrame (root, kind, id, and more) for each binding, as ``run`` does."""

    def step(op: object, name: str, rows: DataFrame) -> DataFrame:
        available, failed = _runnable(op, snapshot)
        if not available or failed:
            return _nothing(rows)
        return _apply(op, rows, snapshot, snapshot.search[op.surface](rows, op.query) if isinstance(op, Search) else None)

    return _walk(plan, snapshot, start, step)


def run(plan: Plan, snapshot: Snapshot, scratch: Scratch, start: dict[str, DataFrame] | None = None) -> Execution:
    """Execute a plan and measure it while it runs; ``scratch`` owns the rows of its operations.

    Each operation is one job. It writes its rows, counts them in the tasks that write
    (each counts once, however often executors are lost), and the next operations read
    what was written: a path of n operations does n steps, and what several paths start
    from is computed once. Orders are spread over tasks, however long that of one root is. A search with a limit is written before the cut, too, since
    what it found decides whether the limit cut anything.

    ``start`` may give large start sets as tables instead of lists of ids. An operation
    that the snapshot cannot run gives no rows and the status ``surface_unavailable``,
    one that asks beyond a hard limit ``failed``; neither starts a job. What that means for
    the plan depends on whether it is required (``report.overall_status``).
    """
    measured: list[dict] = []

    def ordered(rows: DataFrame, group: str, order: list) -> DataFrame:
        return T.spread_order(rows, group, order, scratch)

    def step(op: object, name: str, rows: DataFrame) -> DataFrame:
        available, failed = _runnable(op, snapshot)
        if not available or failed:
            rows, observed = _nothing(rows), 0
        elif isinstance(op, Search) and op.limit is not None:
            found, _ = _written(snapshot.search[op.surface](rows, op.query), scratch)
            observed = found.groupBy("root").count().agg(F.max("count")).first()[0] or 0
            rows, _ = _written(_apply(op, rows, snapshot, found, ordered), scratch)
            scratch.drop(found)
        else:
            found = snapshot.search[op.surface](rows, op.query) if isinstance(op, Search) else None
            rows, observed = _written(_apply(op, rows, snapshot, found, ordered), scratch)
        surface, bound = (op.surface, op.limit) if isinstance(op, Search) else (None, None)
        measured.append({"operation_id": name, "kind": type(op).__name__.lower(), "surface_id": surface, "required": op.required, "observed": observed, "bound": bound, "available": available, "failed": failed})
        return rows

    bindings = _walk(plan, snapshot, start, step, ordered)
    return Execution(bindings, snapshot.records.sparkSession.createDataFrame([tuple(m.values()) for m in measured], OPERATIONS))


def _written(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Write rows and return them with the number that the writing tasks observed."""
    seen = Observation()
    table = scratch.write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    return table, seen.get["rows"]


def _runnable(op: object, snapshot: Snapshot) -> tuple[bool, bool]:
    """Whether the snapshot has what an operation needs, and whether the operation asks beyond a hard limit."""
    if isinstance(op, Follow):
        return op.transition in snapshot.transitions, False
    if isinstance(op, Search):
        _, modes, hard, listed = snapshot.surfaces.get(op.surface, ((), (), 0, False))
        available = listed and op.mode in modes and op.surface in snapshot.search
        return available, available and op.limit is not None and op.limit > hard
    return True, False


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.where("false").select("root", "kind", "id")


def _apply(op: object, rows: DataFrame, snapshot: Snapshot, found: DataFrame | None = None, ordered: Ordered = T.temporal_order) -> DataFrame:
    if isinstance(op, Follow):
        return T.follow(rows, snapshot.edges, op.transition, op.direction)
    if isinstance(op, Search):
        if op.limit is None:
            return found
        # A surface that ranks says so in ``position``; the cut keeps its best.
        return R.top(found, "root", [*(["position"] if "position" in found.columns else []), "id"], op.limit, "position")
    if isinstance(op, Hydrate):
        return rows.join(snapshot.units, rows["id"] == snapshot.units["unit_id"]).drop("unit_id")
    dated = rows if "anchor" in rows.columns else rows.join(snapshot.anchors, ["kind", "id"])
    if op.how in ("earliest", "latest"):
        return T.earliest(dated, "root", ["anchor", "id", "kind"], latest=op.how == "latest").select("root", "kind", "id", "anchor")
    if op.how == "group":
        return dated.groupBy("root", "kind").agg(F.count("*").alias("contexts"), F.min("anchor").alias("anchor"), F.min("id").alias("id"))
    descending = op.how == "descending"
    keys = [F.col("anchor").desc() if descending else F.col("anchor").asc_nulls_last(), F.col("id")]
    return ordered(dated.drop("position"), "root", keys)


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("root", "id").distinct()


def shape(rows: DataFrame, how: str, snapshot: Snapshot | None = None) -> DataFrame:
    """Give a binding's rows one of the output shapes.

    Units carry their content, regions their object and address, occurrence paths both
    ends, anchors their value, all from ``snapshot``. Groups are rows with ordinals, not
    lists, since a group has no bound.
    """
    if how in ("object_ids", "unit_ids"):
        return _of(rows, {"object_ids": "semantic_object", "unit_ids": "semantic_unit"}[how]).select("id").distinct()
    if how == "units":
        return _of(rows, "semantic_unit").join(snapshot.units.select(F.col("unit_id").alias("id"), "content"), "id").select("root", "id", "content")
    if how == "regions":
        parts = F.split("id", "#", 2)
        return _of(rows, "semantic_region").select("root", "id", parts[0].alias("object_id"), parts[1].alias("address"))
    if how == "occurrence_paths":
        ends = snapshot.edges.where("source_kind = 'occurrence' and transition_id like 'occurrence-%'")
        source = ends.where("direction = 'incoming' and target_kind = 'semantic_object'").select(F.col("source_id").alias("id"), F.col("target_id").alias("source_id"))
        target = ends.where("direction = 'outgoing' and transition_id like '%-target'").select(F.col("source_id").alias("id"), "target_kind", "target_id")
        return _of(rows, "occurrence").join(source, "id").join(target, "id", "left").select("root", "id", "source_id", "target_kind", "target_id")
    if how == "anchors":
        return _of(rows, "temporal_anchor").join(snapshot.anchors.select("id", "anchor"), "id").select("root", "id", "anchor")
    if how == "exact_total":
        return rows.agg(F.count_distinct("id").alias("total"))
    if how == "grouped_by_object":
        owned = _of(rows, "semantic_unit").join(snapshot.units.select(F.col("unit_id").alias("id"), "object_id"), "id")
        return T.temporal_order(owned, "object_id", ["root", "id"], "ordinal").select("object_id", "ordinal", "root", "id")
    if how == "ordered_evidence":
        keys = [*(["position"] if "position" in rows.columns else []), "id"]
        return T.temporal_order(rows.drop("ordinal"), "root", keys, "ordinal").select("root", "ordinal", "kind", "id")
    raise KeyError(f"output shape {how} is not known")


def surface_provenance(rows: DataFrame, plan: Plan, name: str) -> DataFrame:
    """The output shape of that name: (root, id, operation_id, surface_id) of every operation that led to a binding."""
    steps = {x.output: x for x in (*plan.paths, *plan.joins)}
    led: list[tuple[str, str | None]] = []
    todo = [name]
    while todo:
        step = steps.get(todo.pop())
        if isinstance(step, Join):
            todo += step.inputs
        elif step is not None:
            led += [(f"{step.output}.{k}", getattr(op, "surface", None)) for k, op in enumerate(step.operations, 1)]
            todo.append(step.start)
    routes = F.array(*(F.struct(F.lit(o).alias("operation_id"), F.lit(x).cast("string").alias("surface_id")) for o, x in sorted(led)))
    return rows.select("root", "id").distinct().select("root", "id", F.inline(routes))


#: What a problem record may be bound to, by kind of record.
BOUND = {"region": ("address",), "relation": ("path", "transition"), "constraint": ("operation",), "open_tension": ("address", "output")}


def provenance_faults(plan: Plan, bindings: DataFrame) -> DataFrame:
    """Bindings (problem_kind, problem_id, bound_kind, bound_id) to what the plan does not have.

    A binding says why a plan does something; it resolves nothing.
    """
    spark = bindings.sparkSession
    have = [("address", b.name) for b in plan.bindings] + [("path", x.output) for x in plan.paths] + [("output", name) for _, name in plan.outputs]
    have += [("operation", f"{x.output}.{k}") for x in plan.paths for k, _ in enumerate(x.operations, 1)]
    have += [("transition", op.transition) for x in plan.paths for op in x.operations if isinstance(op, Follow)]
    allowed = [(kind, b) for kind, kinds in BOUND.items() for b in kinds]
    known = spark.createDataFrame(sorted(set(have)), "bound_kind string, bound_id string")
    fits = spark.createDataFrame(allowed, "problem_kind string, bound_kind string")
    wrong = bindings.join(fits, ["problem_kind", "bound_kind"], "left_anti").withColumn("fault", F.lit("kind_not_bindable"))
    absent = bindings.join(fits, ["problem_kind", "bound_kind"], "left_semi").join(known, ["bound_kind", "bound_id"], "left_anti").withColumn("fault", F.lit("not_in_plan"))
    return wrong.unionByName(absent)


def carry_provenance(rows: DataFrame, plan: Plan, name: str, bindings: DataFrame) -> DataFrame:
    """Rows of a binding with every problem record whose addresses, paths or operations led to it."""
    led = surface_provenance(rows, plan, name).select("root", "id", F.lit("operation").alias("bound_kind"), F.col("operation_id").alias("bound_id"))
    paths = led.select("root", "id", F.lit("path").alias("bound_kind"), F.regexp_extract("bound_id", r"^(.*)\.\d+$", 1).alias("bound_id")).distinct()
    starts = rows.select("root", "id").distinct().select("root", "id", F.explode(F.array(*(F.lit(x.start) for x in plan.paths))).alias("bound_id"))
    every = led.unionByName(paths).unionByName(starts.select("root", "id", F.lit("address").alias("bound_kind"), "bound_id"))
    return every.join(bindings, ["bound_kind", "bound_id"]).select("root", "id", "problem_kind", "problem_id").distinct()
