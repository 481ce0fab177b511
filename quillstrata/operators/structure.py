"""A vault of notes as record tables, its typed transitions, and its acceptance.

Everything is derived from (object_id, title, class_name, front_matter,
front_lists, body); no table is written by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import projection as P
from quillstrata.operators import traversal as T
from quillstrata.operators import validation as V
from quillstrata.sources import durable_table

# Transitions by id: (from kind, operation, direction, to kind).
TRANSITIONS = {
    "object-region": ("semantic_object", "containment", "outgoing", "semantic_region"),
    "object-unit": ("semantic_object", "containment", "outgoing", "semantic_unit"),
    "region-unit": ("semantic_region", "containment", "outgoing", "semantic_unit"),
    "unit-object": ("semantic_unit", "parent", "outgoing", "semantic_object"),
    "unit-region": ("semantic_unit", "parent", "outgoing", "semantic_region"),
    "object-occurrence-outgoing": ("semantic_object", "occurrence", "outgoing", "occurrence"),
    "unit-occurrence-outgoing": ("semantic_unit", "occurrence", "outgoing", "occurrence"),
    "occurrence-object-target": ("occurrence", "occurrence", "outgoing", "semantic_object"),
    "occurrence-region-target": ("occurrence", "occurrence", "outgoing", "semantic_region"),
    "occurrence-unit-target": ("occurrence", "occurrence", "outgoing", "semantic_unit"),
    "object-occurrence-incoming": ("semantic_object", "occurrence", "incoming", "occurrence"),
    "region-occurrence-incoming": ("semantic_region", "occurrence", "incoming", "occurrence"),
    "unit-occurrence-incoming": ("semantic_unit", "occurrence", "incoming", "occurrence"),
    "occurrence-object-source": ("occurrence", "occurrence", "incoming", "semantic_object"),
    "occurrence-unit-source": ("occurrence", "occurrence", "incoming", "semantic_unit"),
    "identifier": ("semantic_object", "identifier", "outgoing", "identifier"),
    "temporal-anchor": ("semantic_object", "temporal_anchor", "outgoing", "temporal_anchor"),
    "occurrence-unit-hydration": ("occurrence", "hydration", "outgoing", "semantic_unit"),
    "unit-unit-hydration": ("semantic_unit", "hydration", "outgoing", "semantic_unit"),
}
# Surfaces by kind: (mode, returned kind, coverage, total count, visible kinds).
SURFACES = {
    "exact": ("literal", "semantic_unit", "exhaustive", True, ("semantic_object", "semantic_region", "semantic_unit", "identifier")),
    "lexical": ("terms", "semantic_unit", "bounded", False, ("semantic_object", "semantic_region", "semantic_unit", "identifier")),
    "vector": ("nearest_neighbours", "semantic_unit", "bounded", False, ("semantic_object", "semantic_region", "semantic_unit")),
    "graph": ("incidence", "occurrence", "bounded", False, ("semantic_object", "semantic_region", "semantic_unit", "occurrence", "identifier")),
    "temporal": ("temporal", "semantic_unit", "bounded", False, ("semantic_object", "semantic_region", "semantic_unit", "temporal_anchor", "identifier")),
}
#: Candidates of a surface, by default and at most.
DEFAULT_LIMIT, HARD_LIMIT = 8, 32
#: Characters of a transport segment.
SEGMENT = 280
KINDS = ("semantic_object", "semantic_region", "semantic_unit", "occurrence", "identifier", "temporal_anchor")


@dataclass
class Vault:
    """The record tables of one snapshot."""

    objects: DataFrame
    regions: DataFrame
    units: DataFrame
    occurrences: DataFrame
    assignments: DataFrame
    anchors: DataFrame
    surfaces: DataFrame
    transitions: DataFrame


def authored_links(notes: DataFrame, units: DataFrame) -> DataFrame:
    """Links of bodies and of front matter, as authored."""
    body = P.wikilinks(units.select(F.struct("object_id", "unit_id", F.col("ordinal").alias("unit_ordinal")).alias("from"), "content"), "from", "content")
    written = F.concat(F.map_values("front_matter"), F.flatten(F.map_values("front_lists")))
    front = notes.select(F.struct("object_id", F.lit(None).cast("string").alias("unit_id"), F.lit(0).cast("long").alias("unit_ordinal")).alias("from"), F.array_join(F.filter(F.array_sort(written), lambda x: x.contains("[[")), "\n").alias("content"))
    links = body.unionByName(P.wikilinks(front, "from", "content"))
    return links.select(F.concat_ws(":", F.lit("occ"), "source_id.object_id", "source_id.unit_ordinal", "ordinal").alias("occurrence_id"), F.col("source_id.object_id").alias("source_object_id"), F.col("source_id.unit_id").alias("source_unit_id"), "target", "heading", "block_id", "alias", "embed")


def resolved_links(links: DataFrame, names: DataFrame, units: DataFrame, regions: DataFrame) -> DataFrame:
    """Authored links with their canonical targets, among the objects of ``names`` (name, target_id), and their units and regions."""
    named = P.resolve(links, names)
    places = regions.where("level > 0").groupBy(F.col("object_id").alias("target_id"), F.col("title").alias("heading")).agg(F.count("*").alias("places"), F.min("address").alias("address"))
    blocks = units.where("block_id <> ''").groupBy(F.col("object_id").alias("target_id"), "block_id").agg(F.count("*").alias("blocks"), F.min("unit_id").alias("block_unit"))
    found = named.join(places, ["target_id", "heading"], "left").join(blocks, ["target_id", "block_id"], "left")
    many = F.when(F.col("heading").isNotNull(), F.coalesce("places", F.lit(0))).when(F.col("block_id").isNotNull(), F.coalesce("blocks", F.lit(0))).otherwise(1)
    status = F.when(F.col("status") != "resolved", F.col("status")).when(many == 1, "resolved").when(many > 1, "ambiguous").otherwise("unresolved")
    kind = F.when(F.col("heading").isNotNull(), "semantic_region").when(F.col("block_id").isNotNull(), "semantic_unit").otherwise("semantic_object")
    identity = F.when(F.col("heading").isNotNull(), F.concat_ws("#", "target_id", "address")).when(F.col("block_id").isNotNull(), F.col("block_unit")).otherwise(F.col("target_id"))
    real = F.col("status") == "resolved"
    rows = found.withColumn("status", status)
    return rows.select("occurrence_id", "source_object_id", "source_unit_id", "target", "heading", "block_id", "alias", "embed", "status", F.when(real, kind).alias("target_kind"), F.when(real, identity).alias("target_id"))


def _kept(table: DataFrame) -> DataFrame:
    return table


def own_tables(notes: DataFrame, descriptors: DataFrame, keep: Callable[[DataFrame], DataFrame] = _kept) -> dict[str, DataFrame]:
    """Objects, regions, units, assignments and anchors: what each note holds whatever the others hold.

    ``keep`` may write a table and return its reader; each is kept before others are made
    of it, so that bodies are read in lines once for regions and once for units.
    """
    regions = keep(P.markdown_regions(notes).withColumn("region_id", F.concat_ws("#", "object_id", "address")))
    blocks = P.markdown_blocks(notes)
    address = P.region_address(F.col("heading_path"))
    units = keep(blocks.select(P.unit_id(F.col("object_id"), address, F.col("ordinal")).alias("unit_id"), "object_id", F.concat_ws("#", "object_id", address).alias("region_id"), "ordinal", "block_type", "content", "block_id"))
    fields = notes.select("object_id", "class_name", F.explode("front_matter").alias("identifier_name", "value"))
    assignments = keep(fields.join(descriptors, "identifier_name", "left_semi").withColumn("assignment_id", F.concat_ws(":", F.lit("id"), "object_id", "identifier_name")))
    counts = units.groupBy("object_id").agg(F.count("*").alias("n_units"))
    objects = keep(notes.select("object_id", "title", "class_name").join(counts, "object_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0))))
    return {"objects": objects, "regions": regions, "units": units, "assignments": assignments, "anchors": keep(P.temporal_anchors(assignments, descriptors))}


def build(notes: DataFrame, descriptors: DataFrame, keep: Callable[[DataFrame], DataFrame] = _kept) -> Vault:
    """Build the record tables of admitted notes; ``keep`` is as in ``own_tables``.

    ``descriptors`` has identifier_name and temporal_affordance; front-matter fields
    without a descriptor are no identifiers. Objects count what they contain, so
    that a lost record shows.
    """
    spark = notes.sparkSession
    own = own_tables(notes, descriptors, keep)
    names = notes.select(F.col("title").alias("name"), F.col("object_id").alias("target_id"))
    occurrences = keep(resolved_links(authored_links(notes, own["units"]), names, own["units"], own["regions"]))
    surfaces = [(f"surface:{k}", k, mode, back, cover, total, list(kinds), DEFAULT_LIMIT, HARD_LIMIT, True) for k, (mode, back, cover, total, kinds) in SURFACES.items()]
    transitions = [(k, *v) for k, v in TRANSITIONS.items()]
    return Vault(
        own["objects"],
        own["regions"],
        own["units"],
        occurrences,
        own["assignments"],
        own["anchors"],
        spark.createDataFrame(surfaces, "surface_id string, kind string, mode string, returned string, coverage string, total_count boolean, visible_kinds array<string>, default_limit int, hard_limit int, available boolean"),
        spark.createDataFrame(transitions, "transition_id string, from_kind string, operation string, direction string, to_kind string"),
    )


def stored(notes: DataFrame, descriptors: DataFrame) -> Vault:
    """Build a snapshot and write its tables, so that every check and plan reads them instead of building them."""
    return build(notes, descriptors, durable_table)


def records(v: Vault) -> DataFrame:
    """All records as (kind, id)."""
    ids = {"semantic_object": (v.objects, "object_id"), "semantic_region": (v.regions, "region_id"), "semantic_unit": (v.units, "unit_id"), "occurrence": (v.occurrences, "occurrence_id"), "identifier": (v.assignments, "assignment_id"), "temporal_anchor": (v.anchors, "anchor_id")}
    return reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, (rows, key) in ids.items()))


def transition_edges(v: Vault) -> DataFrame:
    """Edges of all typed transitions between the records of a vault."""
    real = v.occurrences.where("status = 'resolved'")
    bodies = v.occurrences.where("source_unit_id is not null")
    by_kind = {k: real.where(F.col("target_kind") == f"semantic_{k}") for k in ("object", "region", "unit")}
    ends = {
        "object-region": (v.regions, "object_id", "region_id"),
        "object-unit": (v.units, "object_id", "unit_id"),
        "region-unit": (v.units, "region_id", "unit_id"),
        "unit-object": (v.units, "unit_id", "object_id"),
        "unit-region": (v.units, "unit_id", "region_id"),
        "object-occurrence-outgoing": (v.occurrences, "source_object_id", "occurrence_id"),
        "unit-occurrence-outgoing": (bodies, "source_unit_id", "occurrence_id"),
        **{f"occurrence-{k}-target": (rows, "occurrence_id", "target_id") for k, rows in by_kind.items()},
        **{f"{k}-occurrence-incoming": (rows, "target_id", "occurrence_id") for k, rows in by_kind.items()},
        "occurrence-object-source": (v.occurrences, "occurrence_id", "source_object_id"),
        "occurrence-unit-source": (bodies, "occurrence_id", "source_unit_id"),
        "identifier": (v.assignments, "object_id", "assignment_id"),
        "temporal-anchor": (v.anchors, "object_id", "anchor_id"),
        "occurrence-unit-hydration": (bodies, "occurrence_id", "source_unit_id"),
        "unit-unit-hydration": (v.units, "unit_id", "unit_id"),
    }
    parts = (T.edges(rows, TRANSITIONS[name][0], source, name, TRANSITIONS[name][3], target, TRANSITIONS[name][2]) for name, (rows, source, target) in ends.items())
    return reduce(DataFrame.unionByName, parts)


def activate(v: Vault, per_kind: int) -> DataFrame:
    """A bounded view: the first records of each kind with provenance, total and what is cut."""
    all_ = records(v)
    totals = all_.groupBy("kind").agg(F.count("*").alias("total"))
    first = [all_.where(F.col("kind") == kind).orderBy("id").limit(per_kind) for kind in KINDS]
    shown = reduce(DataFrame.unionByName, first)
    counts = shown.groupBy("kind").agg(F.count("*").alias("shown"))
    counted = totals.join(counts, "kind").withColumn("cut", F.col("total") - F.col("shown"))
    return shown.join(F.broadcast(counted), "kind").withColumn("provenance", F.lit("configured_default"))


def listed_incoming(v: Vault) -> DataFrame:
    """Return (record_id, occurrence_id): the reverse incidence that the transitions expose."""
    edges = transition_edges(v).where("direction = 'incoming' and target_kind = 'occurrence'")
    return edges.select(F.col("source_id").alias("record_id"), F.col("target_id").alias("occurrence_id"))


def acceptance(v: Vault, view: DataFrame, incoming: DataFrame | None = None, segments: DataFrame | None = None) -> dict[str, DataFrame]:
    """The 21 acceptance conditions, each with the rows that fail it.

    ``view`` is what ``activate`` returns; what it says of totals and cuts is held against
    the tables. ``incoming`` (record_id, occurrence_id) is the reverse incidence that
    targets expose, by default that of the transitions; ``segments`` are the units'
    transport segments, by default cut anew.
    """
    known = records(v)
    real = v.occurrences.where("status = 'resolved'")
    if incoming is None:
        incoming = listed_incoming(v)
    held = known.groupBy("kind").agg(F.count("*").alias("held"))
    shown = view.groupBy("kind").agg(F.count("*").alias("seen"))
    # What the view says of each kind that has records, and nothing of a kind that it does not name.
    claims = held.join(shown, "kind", "left").join(view.select("kind", "total", "cut").distinct(), "kind", "left")

    def lost(rows: DataFrame, kind: str, key: str) -> DataFrame:
        return V.unresolved(rows, key, known.where(F.col("kind") == kind), "id")

    def not_unique(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias("times")).where(f"times > 1 or {key} is null").select(key)

    if segments is None:
        segments = P.transport_segments(v.units.select("object_id", "ordinal", "content"), SEGMENT)
    rebuilt = P.rebuild(segments).withColumnRenamed("content", "again")
    sees = v.surfaces.select("surface_id", "available", F.explode("visible_kinds").alias("kind"))
    affordances = v.assignments.select("identifier_name").distinct().crossJoin(F.broadcast(v.surfaces.where("kind <> 'vector'").select("surface_id")))
    seen = sees.where("kind = 'identifier' and available").select("surface_id")
    wanted = v.transitions.sparkSession.createDataFrame([(k, *x) for k, x in TRANSITIONS.items()], "transition_id string, from_kind string, operation string, direction string, to_kind string")
    return {
        "01_objects_have_uuids": not_unique(v.objects, "object_id").unionByName(v.objects.where("not object_id rlike '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'").select("object_id")),
        "02_names_are_no_identities": v.objects.where("object_id = title"),
        "03_regions_addressable": not_unique(v.regions, "region_id"),
        "04_units_addressable": not_unique(v.units, "unit_id"),
        "05_units_have_object_and_region": lost(v.units, "semantic_object", "object_id").select("unit_id").unionByName(lost(v.units, "semantic_region", "region_id").select("unit_id")),
        "06_objects_reach_their_units": V.miscounted(v.objects, v.units, "object_id", "n_units"),
        "07_identifiers_described": v.assignments.where("identifier_name is null or class_name is null"),
        "08_affordances_exposed": affordances.join(seen, "surface_id", "left_anti"),
        "09_occurrences_reach_targets": real.join(known.select(F.col("kind").alias("target_kind"), F.col("id").alias("target_id")), ["target_kind", "target_id"], "left_anti"),
        "10_targets_list_incoming": real.join(incoming.select(F.col("record_id").alias("target_id"), "occurrence_id"), ["target_id", "occurrence_id"], "left_anti"),
        "11_headings_reach_regions": lost(real.where("heading is not null"), "semantic_region", "target_id"),
        "12_blocks_reach_units": lost(real.where("block_id is not null"), "semantic_unit", "target_id"),
        "13_anchors_have_subjects": lost(v.anchors, "semantic_object", "object_id"),
        "14_segments_keep_their_unit": v.units.join(rebuilt, ["object_id", "ordinal"], "left").where("again is null or again <> content"),
        "15_surfaces_state_bounds": v.surfaces.where("size(visible_kinds) = 0 or default_limit > hard_limit or default_limit < 1").select("surface_id").unionByName(V.coverage_faults(v.surfaces).select("surface_id")),
        "16_transitions_represented": wanted.join(v.transitions, wanted.columns, "left_anti"),
        "17_activation_has_provenance": view.where("provenance is null"),
        "18_nothing_is_silently_cut": claims.where(~F.coalesce(F.col("cut") == F.col("held") - F.coalesce("seen", F.lit(0)), F.lit(False))),
        "19_view_states_totals": claims.where(~F.coalesce(F.col("total") == F.col("held"), F.lit(False)) | F.col("cut").isNull()),
        "20_no_surface_is_the_whole": v.surfaces.where(F.size("visible_kinds") >= len(KINDS)),
        "21_view_makes_no_records": view.join(known, ["kind", "id"], "left_anti"),
    }


def authored_text_missing(v: Vault) -> DataFrame:
    """Occurrences whose authored link does not stand in their unit."""
    body = v.occurrences.where("source_unit_id is not null").join(v.units.select(F.col("unit_id").alias("source_unit_id"), "content"), "source_unit_id", "left")
    anchor: Column = F.coalesce(F.concat(F.lit("#"), "heading"), F.concat(F.lit("#^"), "block_id"), F.lit(""))
    text = F.concat(F.when(F.col("embed"), "!").otherwise(""), F.lit("[["), "target", anchor, F.coalesce(F.concat(F.lit("|"), "alias"), F.lit("")), F.lit("]]"))
    return body.where(~F.coalesce(F.col("content").contains(text), F.lit(False)))


def dated_faults(v: Vault, descriptors: DataFrame) -> DataFrame:
    """Objects that are anchored without being dated, or dated without an anchor."""
    dated = P.temporal_anchors(v.assignments, descriptors)
    return V.undated_anchors(v.anchors, dated).select("object_id").unionByName(V.undated_anchors(dated, v.anchors).select("object_id"))


def capability_faults(v: Vault) -> DataFrame:
    """Surfaces that differ from what their kind declares."""
    rows = [(k, mode, back, cover, total, list(kinds), DEFAULT_LIMIT, HARD_LIMIT) for k, (mode, back, cover, total, kinds) in SURFACES.items()]
    declared = v.surfaces.sparkSession.createDataFrame(rows, "kind string, mode string, returned string, coverage string, total_count boolean, visible_kinds array<string>, default_limit int, hard_limit int")
    return v.surfaces.join(declared, declared.columns, "left_anti")


def invisible_records(v: Vault) -> DataFrame:
    """Kinds of records that no available surface sees."""
    seen = v.surfaces.where("available").select(F.explode("visible_kinds").alias("kind"))
    return records(v).join(seen, "kind", "left_anti")


def unhydrated(v: Vault) -> DataFrame:
    """Occurrences of bodies that the graph surface does not hydrate to a unit."""
    edges = transition_edges(v).where("transition_id = 'occurrence-unit-hydration'").select(F.col("source_id").alias("occurrence_id"), F.col("target_id").alias("unit_id"))
    return v.occurrences.where("source_unit_id is not null").select("occurrence_id").join(edges.join(v.units.select("unit_id"), "unit_id"), "occurrence_id", "left_anti")
