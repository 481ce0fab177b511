"""Record types of projections, activation, plans, conformance, results and synthesis.

Importing this module adds them to ``records.RECORDS``.
"""

# Names of fields, variants and tags are those of the exchange format.

from __future__ import annotations

import uuid
from dataclasses import dataclass

from quillstrata.functions.records import BAND, RECORDS, STATE, Fault, Flag, Listed, Record, Tagged, Text, Whole

_T, _IDS, _COUNT, _SMALL = Text(), Listed(Text()), Whole("uint64"), Whole("uint32")


@dataclass(frozen=True)
class ObjectId:
    """An object's id: a UUID in any of its written forms."""

    def fault(self, x: object, path: str) -> Fault | None:
        try:
            uuid.UUID(x if isinstance(x, str) else "")
        except ValueError:
            return path, "expected a UUID"
        return None

    def schema(self) -> dict:
        return {"type": "string"}


@dataclass(frozen=True)
class Filled:
    """A string that is not blank."""

    def fault(self, x: object, path: str) -> Fault | None:
        return None if isinstance(x, str) and x.strip() else (path, "expected a string that is not blank")

    def schema(self) -> dict:
        return {"type": "string"}


@dataclass(frozen=True)
class Paired:
    """A union whose variant and value stand side by side, under ``tag`` and ``content``."""

    tag: str
    content: str
    variants: dict[str, object]

    def _records(self) -> dict[str, Record]:
        return {name: Record({self.content: kind}) for name, kind in self.variants.items()}

    def fault(self, x: object, path: str = "$") -> Fault | None:
        return Tagged(self.tag, self._records()).fault(x, path)

    def schema(self) -> dict:
        return Tagged(self.tag, self._records()).schema()


def _record(fields: dict[str, object], *optional: str) -> Record:
    return Record(fields, frozenset(optional))


_KINDS = ("semantic_object", "semantic_unit", "semantic_region", "identifier", "occurrence", "temporal_anchor", "retrieval_surface")
KIND, _ID, _FILLED = Text(_KINDS), ObjectId(), Filled()
DIRECTION, REQUIREMENT, SURFACE = Text(("outgoing", "incoming")), Text(("required", "optional")), Text(("exact", "lexical", "vector", "graph", "temporal"))
_UNIT_IDS, _SIGHTS, _SURFACES = Listed(_FILLED), Listed(_FILLED), _IDS
REGION_ADDRESS = _record({"object_id": _ID, "authored_structural_address": _FILLED})
ADDRESS = Paired("kind", "value", {"object": _ID, "unit": _FILLED, "region": REGION_ADDRESS, "identifier": _record({"identifier_name": _T, "represented_value": _T}, "represented_value"), "occurrence": _FILLED, "temporal_anchor": _FILLED, "retrieval_surface": _record({"surface_id": _T})})
SPAN = _record({"source": _T, "start_byte": _COUNT, "end_byte": _COUNT}, "start_byte", "end_byte")
PROVENANCE = Tagged("kind", {"object_field": _record({"object_id": _ID, "field_path": _T}), "semantic_unit": _record({"unit_id": _FILLED, "source_span": SPAN}, "source_span"), "materialization": _record({"rule": _T, "sources": Listed(ADDRESS)})})
MODE = Tagged("mode", {x: Record({}) for x in ("literal", "terms", "nearest_neighbours", "incidence", "temporal")} | {"declared": _record({"name": _T})})
SOURCE_KIND = Tagged("kind", {"markdown": Record({}), "admitted": _record({"name": _T})})
BLOCK = Text(("paragraph", "list", "block_quote", "table", "code_block", "equation", "callout", "embedded_media"))
VALUE = Paired("kind", "value", {"string": _T, "integer": Whole("int64"), "boolean": Flag(), "semantic_address": ADDRESS, "strings": _IDS, "semantic_addresses": Listed(ADDRESS)})
MOMENT = Paired("precision", "value", {"date": _T, "date_time": _T, "year": Whole("int32"), "ordinal": Whole("int64"), "label": _T})
VALIDATION = Text(("validated", "unvalidated", "invalid"))
ROLE = Tagged("role", {x: Record({}) for x in ("individuation", "object_class", "framework_position", "register_typing", "canonical_naming", "temporal_anchoring", "contextual_relation", "grouping", "indexical_telemetry")} | {"declared": _record({"name": _T})})
LINK_SOURCE = Tagged("kind", {"object_field": _record({"object_id": _ID, "field_path": _T}), "semantic_unit": _record({"unit_id": _FILLED})})
PRESENTATION = Text(("link", "embed"))
SEGMENT = _record({"segment_id": _FILLED, "parent_unit_id": _FILLED, "segment_ordinal": _SMALL, "source_span": SPAN, "total_segments": _SMALL, "reconstruction_group": _T})
CONTENT = Tagged("mode", {"inline": _record({"authored_markdown": _T, "normalized_text": _T}), "hydration_address": _record({"address": _T, "content_hash": _T})})
_LINK = {"occurrence_id": _FILLED, "source": LINK_SOURCE, "authored_target_text": _T, "display_alias": _T, "resolved_target": ADDRESS, "presentation_mode": PRESENTATION, "direction": DIRECTION, "source_span": SPAN}

PROJECTION = _record(
    {
        **{x: _T for x in ("projection_snapshot_id", "ingest_identity", "schema_version", "logical_hash", "corpus_snapshot_identity", "configuration_snapshot_id")},
        "validation_status": VALIDATION,
        "object_classes": Listed(_record({"class_name": _T, "applicable_identifier_names": _IDS, "permitted_source_kinds": Listed(SOURCE_KIND)})),
        "objects": Listed(_record({"object_id": _ID, "source_identity": _T, "source_kind": SOURCE_KIND, "canonical_path": _T, "filename": _T, "title": _T, "aliases": _IDS, "object_class": _T, "region_addresses": Listed(REGION_ADDRESS), "unit_ids": _UNIT_IDS, "identifier_assignment_ids": _IDS, "object_field_occurrence_ids": _SIGHTS, "body_occurrence_ids": _SIGHTS, "incoming_occurrence_ids": _SIGHTS, "temporal_anchor_ids": _SIGHTS, "retrieval_surface_ids": _SURFACES})),
        "regions": Listed(_record({"address": REGION_ADDRESS, "heading_path": _IDS, "heading_identity": _T, "source_span": SPAN, "child_region_addresses": Listed(REGION_ADDRESS), "contained_unit_ids": _UNIT_IDS, "block_target_mappings": Listed(_record({"authored_block_id": _T, "target_unit_id": _FILLED})), "incoming_occurrence_ids": _SIGHTS, "inherited_identifier_assignment_ids": _IDS, "retrieval_surface_ids": _SURFACES}, "source_span")),
        "units": Listed(_record({"unit_id": _FILLED, "parent_object_id": _ID, "parent_region_address": REGION_ADDRESS, "authored_block_type": BLOCK, "heading_path": _IDS, "block_ordinal": _SMALL, "explicit_block_id": _T, "content": CONTENT, "inherited_identifier_assignment_ids": _IDS, "unit_local_identifier_assignment_ids": _IDS, "outgoing_occurrence_ids": _SIGHTS, "incoming_occurrence_ids": _SIGHTS, "temporal_anchor_ids": _SIGHTS, "retrieval_surface_ids": _SURFACES, "source_provenance": PROVENANCE, "transport_segments": Listed(SEGMENT)}, "explicit_block_id")),
        "identifier_descriptors": Listed(_record({"identifier_name": _T, "semantic_role": ROLE, "value_shape": Text(("string", "integer", "boolean", "semantic_address")), "cardinality": Text(("scalar", "collection")), "applicable_address_kinds": Listed(KIND), "assignment_mode": Text(("intrinsic", "inherited", "local", "relational")), "source_surface": _T, "may_contain_canonical_links": Flag(), "temporal_affordance": Text(("none", "creates_anchor", "references_anchor")), "retrieval_surface_ids": _SURFACES, "enabled_transition_ids": _IDS})),
        "identifier_assignments": Listed(_record({"assignment_id": _T, "identifier_name": _T, "subject": ADDRESS, "value": VALUE, "provenance": PROVENANCE})),
        "occurrences": Listed(_record(_LINK, "display_alias", "source_span")),
        "temporal_anchors": Listed(_record({"anchor_id": _FILLED, "subject": ADDRESS, "value": MOMENT, "provenance": PROVENANCE})),
        "retrieval_surfaces": Listed(_record({"surface_id": _T, "kind": SURFACE, "available": Flag(), "visible_address_kinds": Listed(KIND), "match_modes": Listed(MODE), "default_candidate_limit": _SMALL, "hard_candidate_limit": _SMALL, "returned_identity": KIND, "hydrates_to_semantic_units": Flag(), "coverage_semantics": Text(("exhaustive", "bounded", "availability_only")), "exhaustive_total_count_supported": Flag(), "continuation_supported": Flag(), "technical_limitations": _IDS})),
        "valid_transitions": Listed(_record({"transition_id": _T, "from": KIND, "operation": Text(("containment", "parent", "occurrence", "identifier", "temporal_anchor", "hydration", "retrieval_surface")), "direction": DIRECTION, "to": KIND, "retrieval_surface_id": _T}, "retrieval_surface_id")),
    }
)

WHY = Tagged("kind", {"problem_region": _record({"region_id": _T}), "problem_referent": _record({"region_id": _T, "referent_id": _T}), "problem_relation": _record({"relation_id": _T}), "constraint": _record({"constraint_id": _T}), "open_tension": _record({"tension_id": _T}), "open_tension_candidate": _record({"tension_id": _T, "candidate_index": _SMALL}), "attention_band": _record({"region_id": _T, "band": BAND}), "newest_utterance": _record({"utterance_id": _T}), "configured_default": _record({"configuration_key": _T}), "expansion_request": _record({"request_id": _T})})
_WHY, _SEEN = {"activation_provenance": Listed(WHY)}, {"available_surface_ids": _SURFACES}
PREVIEW = Tagged("kind", {"inline": _record({"text": _T, "truncated": Flag()}), "unavailable_without_hydration": Record({})})
ACTIVE_ASSIGNMENT = _record({"assignment_id": _T, "identifier_name": _T, "subject": ADDRESS, "value": VALUE, "record_provenance": PROVENANCE, **_SEEN, **_WHY})
ACTIVE_OCCURRENCE = _record({**_LINK, **_SEEN, **_WHY}, "display_alias", "source_span")
ACTIVE_ANCHOR = _record({"anchor_id": _FILLED, "subject": ADDRESS, "value": MOMENT, "record_provenance": PROVENANCE, **_SEEN, **_WHY})
_VIEW = {"projection_snapshot_id": _T, "configuration_snapshot_id": _T, "problem_space_thread_id": _T, "problem_space_version": _COUNT, "newest_utterance_id": _T}
ORIGIN = Tagged("kind", {"text_probe": _record({"query_text": _T, "match_mode": MODE}), "structural_neighbourhood": _record({"subject": ADDRESS, "transition_id": _T, "direction": DIRECTION}, "transition_id", "direction"), "temporal_probe": _record({"start": MOMENT, "end": MOMENT}, "start", "end")})
FILTER = Tagged("kind", {"transition": _record({"transition_id": _T}), "source_path_prefix": _record({"canonical_path_prefix": _T}), "object_class": _record({"object_class": _T}), "identifier": _record({"identifier_name": _T, "represented_value": VALUE}, "represented_value"), "temporal_range": _record({"start": MOMENT, "end": MOMENT}, "start", "end")})
HANDLE = _record({"handle_id": _T, **_VIEW, "origin": ORIGIN, "access": Tagged("kind", {"projection_structure": Record({}), "retrieval_surface": _record({"surface_id": _T, "surface_kind": SURFACE})}), "filters": Listed(FILTER), "ordering": Tagged("kind", {"projection_vector_order": Record({}), "surface_declared": _record({"ordering_key": _T})}), "next_offset": _COUNT, "remaining_count": _COUNT, "next_page_limit": _SMALL, **_WHY}, "remaining_count")
TELEMETRY = _record({"telemetry_id": _T, "probe_id": _T, "match_mode": MODE, "surface_kind": SURFACE, "surface_id": _T, "candidate_count": Paired("kind", "count", {"exact": _COUNT, "estimated": _COUNT}), "current_depth": _SMALL, "maximum_depth": _SMALL, "returned_count": _COUNT, "remaining_expansion_budget": _COUNT, "truncation_state": Text(("complete", "bounded", "budget_exhausted")), "identifier_type_distribution": Listed(_record({"label": _T, "count": _COUNT})), "temporal_anchor_count": _COUNT, "unresolved_target_count": _COUNT, "continuation_available": Flag(), **_WHY})
ACTIVATED = _record(
    {
        **_VIEW,
        "activated_objects": Listed(_record({"object_id": _ID, "title": _T, "aliases": _IDS, "object_class": _T, "visible_region_addresses": Listed(REGION_ADDRESS), "visible_unit_ids": _UNIT_IDS, "visible_identifier_assignment_ids": _IDS, "contained_region_count": _COUNT, "contained_unit_count": _COUNT, "incoming_occurrence_count": _COUNT, "outgoing_occurrence_count": _COUNT, **_SEEN, **_WHY})),
        "activated_regions": Listed(_record({"address": REGION_ADDRESS, "heading_path": _IDS, "heading_identity": _T, "visible_identifier_assignment_ids": _IDS, "visible_unit_ids": _UNIT_IDS, "contained_unit_count": _COUNT, **_SEEN, **_WHY})),
        "activated_units": Listed(_record({"unit_id": _FILLED, "parent_object_id": _ID, "parent_region_address": REGION_ADDRESS, "authored_block_type": BLOCK, "heading_path": _IDS, "visible_inherited_identifier_assignment_ids": _IDS, "visible_unit_local_identifier_assignment_ids": _IDS, "text_preview": PREVIEW, "incoming_occurrence_count": _COUNT, "outgoing_occurrence_count": _COUNT, "temporal_anchor_count": _COUNT, **_SEEN, **_WHY})),
        "activated_identifier_assignments": Listed(ACTIVE_ASSIGNMENT),
        "activated_occurrences": Listed(ACTIVE_OCCURRENCE),
        "activated_temporal_anchors": Listed(ACTIVE_ANCHOR),
        "edges": Listed(_record({"edge_id": _T, "source": ADDRESS, "transition_id": _T, "direction": DIRECTION, "target": ADDRESS, **_WHY})),
        "telemetry": Listed(TELEMETRY),
        "continuation_handles": Listed(HANDLE),
    }
)
_BANDS = ("unbanded", "primary", "secondary", "tertiary", "background")
CONFIG = _record(
    {
        "configuration_snapshot_id": _T,
        **{b: _record({x: _SMALL for x in ("maximum_textual_seeds", "maximum_structural_neighbors_per_record", "maximum_visible_units_per_region", "text_preview_character_limit")}) for b in _BANDS},
        "surface_limits": Listed(_record({"surface_id": _T} | {f"{b}_candidate_limit": _SMALL for b in _BANDS})),
        "maximum_expansion_budget": _COUNT,
        "hub_degree_threshold": _COUNT,
        **{x: _SMALL for x in ("maximum_initial_relation_depth", "continuation_page_limit", *(f"maximum_activated_{k}" for k in ("objects", "regions", "units", "identifier_assignments", "occurrences", "temporal_anchors", "edges")), "maximum_telemetry_records", "maximum_continuation_handles")},
    }
)
_PART = Text(("object", "region", "unit", "identifier_assignment", "occurrence", "temporal_anchor", "edge", "telemetry", "continuation_handle"))
ACTIVATION_VIOLATION = Tagged(
    "violation",
    {
        "empty_required_identity": _record({"field": _T}),
        "projection_not_validated": _record({"status": VALIDATION}),
        "configuration_snapshot_mismatch": _record({"projection_configuration_snapshot_id": _T, "activation_configuration_snapshot_id": _T}),
        **{x: _record({"surface_id": _T}) for x in ("missing_available_surface_configuration", "unknown_or_unavailable_surface_configuration", "duplicate_surface_configuration")},
        "invalid_configuration_value": _record({"field": _T}),
        "surface_candidate_limit_exceeds_hard_limit": _record({"surface_id": _T, "requested": _SMALL, "hard_maximum": _SMALL}),
        "surface_access_failed": _record({"surface_id": _T, "probe_id": _T, "context": _T}),
        "duplicate_activated_identity": _record({"kind": _PART, "identity": _T}),
        "invalid_activated_reference": _record({"context": _T}),
        "invalid_activation_provenance": _record({"context": _T}),
        "invalid_continuation_handle": _record({"handle_id": _T, "context": _T}),
        "invalid_telemetry": _record({"surface_id": _T, "context": _T}),
        "activated_view_bound_exceeded": _record({"kind": _PART, "actual": _COUNT, "maximum": _SMALL}),
        "count_overflow": Record({}),
    },
)

_FROM = {"problem_space_provenance": Listed(Paired("kind", "id", {x: _T for x in ("region", "relation", "constraint", "open_tension")}))}
QUERY = Tagged("kind", {"literal": _record({"value": _T}), "terms": _record({"values": _IDS}), "vector_from_binding": _record({"binding_id": _T}), "graph": _record({"transition_ids": _IDS, "direction": DIRECTION}), "temporal_range": _record({"start": _T, "end": _T}, "start", "end")})
TEMPORAL = Tagged("kind", {"order": _record({"direction": Text(("ascending", "descending"))}), "group_by_binding": _record({"binding_ids": _IDS}), "earliest_per_binding": Record({}), "latest_per_binding": Record({})})
STEP = Tagged("kind", {"follow_connection": _record({"transition_id": _T, "direction": DIRECTION}), "search_surface": _record({"surface_id": _T, "surface_kind": SURFACE, "match_mode": MODE, "query": QUERY}), "hydrate_semantic_units": Record({}), "evaluate_temporal": _record({"evaluation": TEMPORAL})})
OPERATION = _record({"operation_id": _T, "requirement": REQUIREMENT, "input_bindings": _IDS, "operation": STEP, "constraints": _record({"maximum_depth": _SMALL, "maximum_candidates": _SMALL, "eligible_scope_binding_ids": _IDS}, "maximum_depth", "maximum_candidates"), "output_binding": _T})
COVERAGE = Tagged("kind", {"exhaustive_exact": _record({"surface_id": _T, "eligible_scope_binding_ids": _IDS}), "graph_depth": _record({"depth": _SMALL}), "operations_completed": _record({"operation_ids": _IDS}), "temporal_range": _record({"start": _T, "end": _T}, "start", "end")})
PLAN = _record(
    {
        "plan_id": _T,
        "projection_snapshot_id": _T,
        "problem_space_version": _COUNT,
        "focus_utterance_id": _T,
        "configuration_snapshot_id": _T,
        "problem_space_provenance": _record({"thread_id": _T, "contribution_ids": _IDS}),
        "problem_region_bindings": Listed(_record({"problem_region_id": _T, "address_binding_ids": _IDS, "rationale": _T})),
        "relation_bindings": Listed(_record({"problem_relation_id": _T, "traversal_path_ids": _IDS, "transition_ids": _IDS})),
        "constraint_bindings": Listed(_record({"constraint_id": _T, "operation_ids": _IDS, "requirement": REQUIREMENT})),
        "open_tension_bindings": Listed(_record({"tension_id": _T, "candidate_binding_ids": _IDS, "requested_output_ids": _IDS})),
        "address_bindings": Listed(_record({"binding_id": _T, "address": ADDRESS, **_FROM})),
        "traversal_paths": Listed(_record({"path_id": _T, "start_binding_ids": _IDS, "operations": Listed(OPERATION), "output_binding": _T, **_FROM})),
        "joins": Listed(_record({"join_id": _T, "input_bindings": _IDS, "operation": Text(("group", "concatenate", "temporal_order")), "output_binding": _T})),
        "requested_outputs": Listed(_record({"output_id": _T, "requirement": REQUIREMENT, "kind": Text(("semantic_units", "semantic_object_identities", "semantic_unit_identities", "semantic_regions", "occurrence_paths", "temporal_anchors", "grouped_by_object", "ordered_evidence", "total_exact_count", "surface_provenance")), "source_binding": _T})),
        "coverage_requirements": Listed(_record({"coverage_requirement_id": _T, "requirement": REQUIREMENT, "kind": COVERAGE})),
    }
)

CODES = ("missing_address", "missing_identifier", "identifier_not_applicable", "missing_relation", "direction_unavailable", "surface_unavailable", "input_type_mismatch", "output_unavailable", "configuration_bound_exceeded", "unresolved_authored_target", "unsupported_transition")
DETAIL = Tagged("kind", {"missing_member": _record({"member_kind": KIND, "member": _T}), "identifier_applicability": _record({"identifier_name": _T, "proposed_address_kind": KIND, "applicable_address_kinds": Listed(KIND)}), "direction": _record({"requested": DIRECTION, "available": Listed(DIRECTION)}), "surface": _record({"surface_id": _T, "address_kind": KIND}), "type_mismatch": _record({"expected": KIND, "actual": KIND}), "bound_exceeded": _record({"bound_name": _T, "requested": _COUNT, "maximum": _COUNT}), "unresolved_target": _record({"authored_target": _T, "expected_target_kind": KIND}), "transition": _record({"transition_id": _T, "explanation": _T})})
VIOLATION = _record({"operation_id": _T, "address": ADDRESS, "code": Text(CODES), "detail": DETAIL, "requirement": REQUIREMENT}, "operation_id", "address", "requirement")
_CHECKED = {"plan_id": _T, "projection_snapshot_id": _T}
CONFORMANCE = Tagged("status", {"valid": _record(_CHECKED), "invalid": _record({**_CHECKED, "violations": _record({"first": VIOLATION, "additional": Listed(VIOLATION)})})})

STATUS = Tagged("status", {"completed": Record({}), "completed_zero_matches": Record({}), "truncated": _record({"reason": _T}), "surface_unavailable": _record({"surface_id": _T}), "failed": _record({"reason": _T})})
ROUTE = _record({"surface_id": _T, "path_id": _T, "operation_id": _T, "traversed_addresses": Listed(ADDRESS), "occurrence_ids": _SIGHTS, "temporal_anchor_ids": _SIGHTS})
RETURNED = _record({"unit_id": _FILLED, "parent_object_id": _ID, "parent_region_address": REGION_ADDRESS, "authored_content": _T, "identifier_assignments": Listed(_record({"assignment_id": _T, "identifier_name": _T, "value": VALUE, "provenance": PROVENANCE})), "outgoing_occurrence_ids": _SIGHTS, "incoming_occurrence_ids": _SIGHTS, "temporal_anchors": Listed(_record({"anchor_id": _FILLED, "value": MOMENT, "provenance": PROVENANCE})), "retrieval_provenance": Listed(ROUTE), "transport_segment_provenance": Listed(_record({"segment_id": _FILLED, "segment_ordinal": _SMALL, "total_segments": _SMALL}))})
RESULT = _record({**_CHECKED, "execution_status": Text(("complete", "partial", "failed")), "returned_units": Listed(RETURNED), "operation_results": Listed(_record({"operation_id": _T, "requirement": REQUIREMENT, "status": STATUS, "returned_unit_ids": _UNIT_IDS, "inspected_candidate_count": _COUNT}))})
FACT = Tagged("kind", {"exhaustive_exact_completed": _record({"surface_id": _T, "eligible_scope": _T, "total_matches": _COUNT}), "operation_completed": _record({"operation_id": _T, "requirement": REQUIREMENT}), "graph_depth_reached": _record({"path_id": _T, "depth": _SMALL}), "candidate_cap_applied": _record({"operation_id": _T, "cap": _COUNT, "total_candidates": _COUNT}, "total_candidates"), "surface_unavailable": _record({"surface_id": _T, "affected_operation_ids": _IDS}), "temporal_range_covered": _record({"start": _T, "end": _T, "inspected_anchor_count": _COUNT}, "start", "end")})
LIMITS = _record({"plan_id": _T, "requested_operation_count": _COUNT, "completed_operation_count": _COUNT, "failed_required_operation_ids": _IDS, "failed_optional_operation_ids": _IDS, "coverage_facts": Listed(FACT), "applied_bounds": Listed(_record({"bound_name": _T, "configured_limit": _COUNT, "observed_value": _COUNT, "truncated": Flag()}))})
UTTERANCE = _record({"utterance_id": _T, "text": _T})
SYNTHESIS = _record({"current_problem_space": STATE, "newest_utterance": UTTERANCE, "previous_turn": _record({"turn_id": _T, "user_utterance": _T, "assistant_response": _T}), "semantic_access_plan": PLAN, "retrieval_result": RESULT, "execution_limits": LIMITS}, "previous_turn")

RECORDS |= {
    "semantic-space-projection": PROJECTION,
    "activated-projection": ACTIVATED,
    "activated-text-preview": PREVIEW,
    "activation-utterance": UTTERANCE,
    "projection-activation-config": CONFIG,
    "projection-activation-violation": ACTIVATION_VIOLATION,
    "activated-identifier-assignment-record": ACTIVE_ASSIGNMENT,
    "activated-occurrence-record": ACTIVE_OCCURRENCE,
    "activated-temporal-anchor-record": ACTIVE_ANCHOR,
    "continuation-handle": HANDLE,
    "semantic-access-plan": PLAN,
    "conformance-result": CONFORMANCE,
    "retrieval-result": RESULT,
    "execution-limits": LIMITS,
    "synthesis-input": SYNTHESIS,
}
