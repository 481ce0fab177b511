"""Queries over a vault of Markdown notes.

Each customer and each nation is written as a note, with front matter, headings,
lists, code, quotes and wikilinks; the notes are then parsed like authored files.
The SQL states from the same tables what the notes must contain.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import activation as A
from quillstrata.operators import faults as B
from quillstrata.operators import projection as P
from quillstrata.operators import structure as S
from quillstrata.operators import surfaces as R
from quillstrata.operators import traversal as T
from quillstrata.operators import validation as V
from quillstrata.plans import access as X
from quillstrata.plans import report as Q
from quillstrata.sources import Scratch, durable_table, read_table, shared, spread
from quillstrata.sources.notes import admit, parse_notes


def _uuid(text: Column) -> Column:
    digest = F.md5(text)
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all customers and nations, written and parsed again."""
    customer, nation, region = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    rows = spread(customer, "c_custkey").join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    before = F.concat(F.lit("Customer "), F.lpad((key - 1).cast("string"), 9, "0"))
    lines = [
        F.lit("---"),
        F.concat(F.lit("uuid: "), F.upper(_uuid(F.concat(F.lit("customer:"), key.cast("string"))))),
        F.lit("class: customer"),
        F.when(key % 3 == 0, F.concat(F.lit("joined: 2020-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))),
        F.lit("homes:"),
        F.concat(F.lit('  - "[['), "n_name", F.lit(']]"')),
        F.lit("---"),
        F.concat(F.lit("Intro of "), name, F.lit(".")),
        F.lit("\n# Profile\n"),
        F.concat(F.lit("Segment is "), "c_mktsegment", F.lit(",\nsee [["), "n_name", F.lit("#Facts|home]].")),
        F.lit("\n## Empty\n\n## Listing\n\n- one"),
        F.concat(F.lit("- two ^list"), key.cast("string")),
        F.lit("\n# Code\n\n```\n# not a heading\n\nstill code\n```\n"),
        F.concat(F.lit("> quote of [["), before, F.lit("#^list"), (key - 1).cast("string"), F.lit("]]"), F.when(key % 5 == 0, F.concat(F.lit(" ![[Missing "), key.cast("string"), F.lit("]]"))).otherwise("")),
    ]
    files = rows.select(F.concat(name, F.lit(".md")).alias("filename"), F.concat_ws("\n", *lines).alias("text"))
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    text = F.concat(F.lit("---\nuuid: "), _uuid(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))), F.lit("\nclass: nation\n---\n# Facts\n\nRegion "), "r_name", F.lit(".\n"))
    files = files.unionByName(places.select(F.concat("n_name", F.lit(".md")).alias("filename"), text.alias("text")))
    parsed = admit(parse_notes(files.select(F.concat(F.lit("vault/"), "filename").alias("path"), "filename", "text"))).where("admission = 'admitted'")
    return parsed.select("object_id", F.regexp_replace("filename", r"\.md$", "").alias("title"), F.col("front_matter")["class"].alias("class_name"), "front_matter", "front_lists", "body")


def descriptors(spark: SparkSession) -> DataFrame:
    """The identifiers of notes; joining dates make anchors."""
    return spark.createDataFrame([("class", "none"), ("joined", "creates_anchor")], "identifier_name string, temporal_affordance string")


def vault(spark: SparkSession, sf_dir: str) -> S.Vault:
    """The record tables of the notes, written once an application as a snapshot that all queries share."""

    def build() -> S.Vault:
        return S.stored(durable_table(notes(spark, sf_dir)), descriptors(spark))

    return replace(shared(spark, sf_dir, ("customer", "nation", "region"), "vault", build))


def _id(text: str) -> str:
    return f"(substr(md5({text}), 1, 8) || '-' || substr(md5({text}), 9, 4) || '-' || substr(md5({text}), 13, 4) || '-' || substr(md5({text}), 17, 4) || '-' || substr(md5({text}), 21, 12))"


_CTE = f"""WITH c AS (SELECT c_custkey AS k, replace(c_name, '#', ' ') AS title, c_mktsegment AS seg, n_name AS home, {_id("'customer:' || c_custkey::VARCHAR")} AS id, {_id("'nation:' || n_nationkey::VARCHAR")} AS home_id,
    'Customer ' || lpad((c_custkey - 1)::VARCHAR, 9, '0') AS before FROM customer JOIN nation ON c_nationkey = n_nationkey),
  n AS (SELECT n_name AS title, r_name AS place, {_id("'nation:' || n_nationkey::VARCHAR")} AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
  o AS (SELECT id AS object_id, title, 'customer' AS class_name, 5 AS n_units FROM c UNION ALL SELECT id, title, 'nation', 1 FROM n),
  g AS (SELECT id AS object_id, unnest(['root', 'Profile', 'Profile > Empty', 'Profile > Listing', 'Code']) AS address, unnest([0, 1, 2, 3, 4]) AS ordinal, unnest([0, 1, 2, 2, 1]) AS level, unnest([NULL, 'root', 'Profile', 'Profile', 'root']) AS parent_address FROM c
    UNION ALL SELECT id, unnest(['root', 'Facts']), unnest([0, 1]), unnest([0, 1]), unnest([NULL, 'root']) FROM n),
  u AS (SELECT id AS object_id, unnest(['root', 'Profile', 'Profile > Listing', 'Code', 'Code']) AS address, unnest([1, 2, 3, 4, 5]) AS ordinal, unnest(['paragraph', 'paragraph', 'list', 'code_block', 'block_quote']) AS block_type,
      unnest(['Intro of ' || title || '.', 'Segment is ' || seg || ',' || chr(10) || 'see [[' || home || '#Facts|home]].', '- one' || chr(10) || '- two ^list' || k::VARCHAR, '```' || chr(10) || '# not a heading' || chr(10) || chr(10) || 'still code' || chr(10) || '```',
        '> quote of [[' || before || '#^list' || (k - 1)::VARCHAR || ']]' || CASE WHEN k % 5 = 0 THEN ' ![[Missing ' || k::VARCHAR || ']]' ELSE '' END]) AS content, unnest(['', '', 'list' || k::VARCHAR, '', '']) AS block_id FROM c
    UNION ALL SELECT id, 'Facts', 1, 'paragraph', 'Region ' || place || '.', '' FROM n),
  x AS (SELECT 'occ:' || id || ':0:1' AS occurrence_id, id AS source_object_id, NULL AS source_unit_id, home AS target, NULL AS heading, NULL AS block_id, NULL AS alias, false AS embed, 'resolved' AS status, 'semantic_object' AS target_kind, home_id AS target_id FROM c
    UNION ALL SELECT 'occ:' || id || ':2:1', id, id || '#Profile#2', home, 'Facts', NULL, 'home', false, 'resolved', 'semantic_region', home_id || '#Facts' FROM c
    UNION ALL SELECT 'occ:' || a.id || ':5:1', a.id, a.id || '#Code#5', a.before, NULL, 'list' || (a.k - 1)::VARCHAR, NULL, false, CASE WHEN b.id IS NULL THEN 'unresolved' ELSE 'resolved' END, CASE WHEN b.id IS NOT NULL THEN 'semantic_unit' END, b.id || '#Profile > Listing#3' FROM c a LEFT JOIN c b ON b.title = a.before
    UNION ALL SELECT 'occ:' || id || ':5:2', id, id || '#Code#5', 'Missing ' || k::VARCHAR, NULL, NULL, NULL, true, 'unresolved', NULL, NULL FROM c WHERE k % 5 = 0),
  i AS (SELECT object_id, 'class' AS identifier_name, class_name AS value FROM o UNION ALL SELECT id, 'joined', '2020-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') FROM c WHERE k % 3 = 0)"""


@register("vault_objects", f"{_CTE} SELECT object_id, title, class_name, n_units::BIGINT AS n_units FROM o")
def vault_objects(spark, sf_dir):
    """Objects of the notes."""
    return vault(spark, sf_dir).objects.select("object_id", "title", "class_name", "n_units")


@register("vault_regions", f"{_CTE} SELECT object_id, address, ordinal::BIGINT AS ordinal, level::BIGINT AS level, parent_address FROM g")
def vault_regions(spark, sf_dir):
    """Regions, headings without prose included."""
    return vault(spark, sf_dir).regions.select("object_id", "address", "ordinal", "level", "parent_address")


@register("vault_units", f"{_CTE} SELECT object_id || '#' || address || '#' || ordinal::VARCHAR AS unit_id, block_type, content, block_id FROM u")
def vault_units(spark, sf_dir):
    """Blocks as units, with their identities."""
    return vault(spark, sf_dir).units.select("unit_id", "block_type", "content", "block_id")


@register("vault_occurrences", f"{_CTE} SELECT * FROM x")
def vault_occurrences(spark, sf_dir):
    """Links of bodies and front matter, with canonical targets."""
    v = vault(spark, sf_dir)
    return v.occurrences.select("occurrence_id", "source_object_id", "source_unit_id", "target", "heading", "block_id", "alias", "embed", "status", "target_kind", "target_id")


@register("vault_block_targets", f"{_CTE} SELECT object_id, block_id, ordinal::BIGINT AS ordinal FROM u WHERE block_id <> ''")
def vault_block_targets(spark, sf_dir):
    """Block ids, each with its one unit."""
    return P.block_targets(vault(spark, sf_dir).units)[0]


_SAME = {"object-region": "SELECT 'semantic_object', object_id, object_id || '#' || address FROM g", "identifier": "SELECT 'semantic_object', object_id, 'id:' || object_id || ':' || identifier_name FROM i", "temporal-anchor": "SELECT 'semantic_object', object_id, 'anchor:joined:' || object_id FROM i WHERE identifier_name = 'joined'"}
_UNIT = "object_id || '#' || address || '#' || ordinal::VARCHAR"
_SAME |= {
    "object-unit": f"SELECT 'semantic_object', object_id, {_UNIT} FROM u",
    "region-unit": f"SELECT 'semantic_region', object_id || '#' || address, {_UNIT} FROM u",
    "unit-object": f"SELECT 'semantic_unit', {_UNIT}, object_id FROM u",
    "unit-region": f"SELECT 'semantic_unit', {_UNIT}, object_id || '#' || address FROM u",
    "object-occurrence-outgoing": "SELECT 'semantic_object', source_object_id, occurrence_id FROM x",
    "unit-occurrence-outgoing": "SELECT 'semantic_unit', source_unit_id, occurrence_id FROM x WHERE source_unit_id IS NOT NULL",
    "occurrence-object-source": "SELECT 'occurrence', occurrence_id, source_object_id FROM x",
    "occurrence-unit-source": "SELECT 'occurrence', occurrence_id, source_unit_id FROM x WHERE source_unit_id IS NOT NULL",
    "occurrence-unit-hydration": "SELECT 'occurrence', occurrence_id, source_unit_id FROM x WHERE source_unit_id IS NOT NULL",
    "unit-unit-hydration": f"SELECT 'semantic_unit', {_UNIT}, {_UNIT} FROM u",
}
for _k in ("object", "region", "unit"):
    _SAME[f"occurrence-{_k}-target"] = f"SELECT 'occurrence', occurrence_id, target_id FROM x WHERE target_kind = 'semantic_{_k}'"
    _SAME[f"{_k}-occurrence-incoming"] = f"SELECT 'semantic_{_k}', target_id, occurrence_id FROM x WHERE target_kind = 'semantic_{_k}'"


@register("transitions_followed", f"{_CTE} " + " UNION ALL ".join(f"SELECT '{name}' AS transition_id, root, id FROM ({sql}) t(from_kind, root, id)" for name, sql in sorted(_SAME.items())))
def transitions_followed(spark, sf_dir):
    """What every record reaches by each of the 19 transitions."""
    v = vault(spark, sf_dir)
    start, edges = S.records(v).select(F.col("id").alias("root"), "kind", "id"), S.transition_edges(v)
    parts = [T.follow(start.where(F.col("kind") == kind), edges, name, direction).select(F.lit(name).alias("transition_id"), "root", "id") for name, (kind, _, direction, _) in S.TRANSITIONS.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def damaged(spark: SparkSession, sf_dir: str) -> S.Vault:
    """The vault without the units of every tenth customer and without the notes of one nation in five."""
    v = vault(spark, sf_dir)
    lost = v.objects.where("class_name = 'customer' and cast(substring(title, 10) as int) % 10 = 0").select("object_id")
    gone = v.objects.where("class_name = 'nation'").join(read_table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("title")), "title", "left_semi").select("object_id")
    v.units = v.units.join(lost, "object_id", "left_anti")
    v.objects = v.objects.join(gone, "object_id", "left_anti")
    return v


def _counted(checks: dict[str, DataFrame]) -> DataFrame:
    return V.report(checks).select("check_name", "failures")


_PASS = "SELECT check_name, 0::BIGINT AS failures FROM (VALUES {0}) t(check_name)"
_CONDITIONS = ("01_objects_have_uuids", "02_names_are_no_identities", "03_regions_addressable", "04_units_addressable", "05_units_have_object_and_region", "06_objects_reach_their_units", "07_identifiers_described", "08_affordances_exposed", "09_occurrences_reach_targets", "10_targets_list_incoming", "11_headings_reach_regions", "12_blocks_reach_units", "13_anchors_have_subjects", "14_segments_keep_their_unit", "15_surfaces_state_bounds", "16_transitions_represented", "17_activation_has_provenance", "18_nothing_is_silently_cut", "19_view_states_totals", "20_no_surface_is_the_whole", "21_view_makes_no_records")


def _zeros(names) -> str:
    return _PASS.format(", ".join(f"('{x}')" for x in names))


@register("acceptance_report", _zeros(_CONDITIONS))
def acceptance_report(spark, sf_dir):
    """The 21 conditions on the whole vault."""
    v = vault(spark, sf_dir)
    return _counted(S.acceptance(v, S.activate(v, 20)))


_FAILING = """
  SELECT '05_units_have_object_and_region' AS check_name, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS failures
  UNION ALL SELECT '06_objects_reach_their_units', (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0)
  UNION ALL SELECT '09_occurrences_reach_targets', (SELECT count(*) FROM x WHERE status = 'resolved' AND target_kind = 'semantic_object' AND target_id IN (SELECT id FROM n WHERE title IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0))) + (SELECT count(*) FROM c a JOIN c b ON b.title = a.before WHERE b.k % 10 = 0)
  UNION ALL SELECT '12_blocks_reach_units', (SELECT count(*) FROM c a JOIN c b ON b.title = a.before WHERE b.k % 10 = 0)"""


@register("acceptance_of_damage", f"{_CTE} {_FAILING} UNION ALL {_zeros(x for x in _CONDITIONS if x[:2] not in ('05', '06', '09', '12'))}")
def acceptance_of_damage(spark, sf_dir):
    """The 21 conditions on a vault that lost records."""
    v = damaged(spark, sf_dir)
    return _counted(S.acceptance(v, S.activate(v, 20)))


_PLANTED = {"08": "2", "15": "2", "16": "1", "17": "1", "18": "1", "19": "1", "20": "1", "21": "1"}


@register("acceptance_of_faults", " UNION ALL ".join(f"SELECT '{x}' AS check_name, {_PLANTED.get(x[:2], '(SELECT count(*) FROM nation)')} AS failures" for x in _CONDITIONS) + " UNION ALL SELECT 'surfaces_capable', 4 UNION ALL SELECT 'coverage_fits', 1")
def acceptance_of_faults(spark, sf_dir):
    """A vault with a fault of every condition: each finds its own, those of records once for every nation."""
    planted = B.plant(vault(spark, sf_dir), read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("key")), 20)
    checks = S.acceptance(planted.vault, planted.view, planted.incoming, planted.segments)
    return _counted(checks | {"surfaces_capable": S.capability_faults(planted.vault), "coverage_fits": V.coverage_faults(planted.vault.surfaces)})


@register("projection_checks", f"{_CTE} {_zeros(('authored_text_present', 'coverage_fits', 'dated_subjects', 'descriptors_unique', 'graph_hydrates', 'inventories_agree', 'links_listed', 'records_visible', 'segments_rebuild', 'surfaces_capable', 'transitions_typed'))} UNION ALL SELECT 'record_counts', (SELECT count(*) FROM o) + (SELECT count(*) FROM g) + (SELECT count(*) FROM u) + (SELECT count(*) FROM x) + (SELECT count(*) FROM i) + (SELECT count(*) FROM i WHERE identifier_name = 'joined')")
def projection_checks(spark, sf_dir):
    """Further integrity checks of the vault: failing rows of each, and the number of all records."""
    v = vault(spark, sf_dir)
    described = descriptors(spark)
    occurrences = v.occurrences.where("status = 'resolved' and source_unit_id is not null").select("occurrence_id", F.col("source_unit_id").alias("source_id"), "target_id", F.lit("semantic_unit").alias("source_kind"), "target_kind")
    edges = S.transition_edges(v)
    listed = edges.where("target_kind = 'occurrence'").select(F.col("source_id").alias("record_id"), F.col("target_id").alias("occurrence_id")).distinct()
    by_object = v.units.groupBy("object_id").agg(F.array_sort(F.collect_set("region_id")).alias("regions"))
    by_edge = edges.where("transition_id = 'unit-region'").select(F.col("source_id").alias("unit_id"), F.col("target_id").alias("region_id")).join(v.units.select("unit_id", "object_id"), "unit_id").groupBy("object_id").agg(F.array_sort(F.collect_set("region_id")).alias("regions"))
    segments = P.transport_segments(v.units.select("object_id", "ordinal", "content"), 16)
    kinds = v.transitions.where("operation = 'occurrence'").select("from_kind", "direction", "to_kind")
    return _counted(
        {
            "record_counts": S.records(v),
            "segments_rebuild": V.unequal_lists(v.units.select(F.col("unit_id"), "content"), P.rebuild(segments).join(v.units.select("object_id", "ordinal", "unit_id"), ["object_id", "ordinal"]), "unit_id", "content"),
            "inventories_agree": V.unequal_lists(by_object, by_edge, "object_id", "regions"),
            "links_listed": V.incidence_faults(occurrences, listed),
            "authored_text_present": S.authored_text_missing(v),
            "transitions_typed": V.missing_transitions(occurrences, kinds),
            "dated_subjects": S.dated_faults(v, described),
            "descriptors_unique": V.repeated(described, ["identifier_name"]),
            "coverage_fits": V.coverage_faults(v.surfaces),
            "surfaces_capable": S.capability_faults(v),
            "records_visible": S.invisible_records(v),
            "graph_hydrates": S.unhydrated(v),
        }
    )


def snapshot(spark: SparkSession, sf_dir: str) -> X.Snapshot:
    """The vault as a snapshot that plans run on."""
    v = vault(spark, sf_dir)
    units = v.units.select("unit_id", "content", "object_id", "region_id")
    anchors = v.anchors.select(F.lit("temporal_anchor").alias("kind"), F.col("anchor_id").alias("id"), F.col("value").alias("anchor"))
    transitions = {name: (kind, (direction,), target) for name, (kind, _, direction, target) in S.TRANSITIONS.items()}
    surfaces = {k: (("semantic_unit",), (mode,), S.HARD_LIMIT, k != "vector") for k, (mode, *_) in S.SURFACES.items()}

    def terms(rows: DataFrame, query: object) -> DataFrame:
        scored = units.withColumn("position", F.length("content") - F.length(F.replace(F.col("content"), F.lit(str(query)), F.lit(""))))
        found = scored.where("position > 0").select(F.lit("all").alias("root"), F.lit("semantic_unit").alias("kind"), F.col("unit_id").alias("id"), (-F.col("position")).alias("position"))
        return found.drop("root").join(rows.select("root", "id"), "id")

    return X.Snapshot(S.records(v), S.transition_edges(v), units, anchors, transitions, surfaces, {"joined": ("semantic_object",)}, {"lexical": terms})


_PATHS = (
    X.Path("homes", (X.Follow("object-occurrence-incoming", "incoming"),), "links"),
    X.Path("links", (X.Follow("occurrence-object-source", "incoming"),), "people"),
    X.Path("people", (X.Follow("temporal-anchor"), X.Temporal("ascending")), "dates"),
    X.Path("people", (X.Follow("object-unit"),), "units"),
    X.Path("people", (X.Follow("object-region"),), "regions"),
    X.Path("units", (X.Search("lexical", "terms", "e", 3),), "hits"),
)
_OUTPUTS = (("object_ids", "people"), ("unit_ids", "units"), ("units", "units"), ("regions", "regions"), ("occurrence_paths", "links"), ("anchors", "dates"), ("grouped_by_object", "units"), ("ordered_evidence", "dates"), ("exact_total", "units"), ("surface_provenance", "hits"))


def _plan(*more: X.Path) -> X.Plan:
    return X.Plan((X.Binding("homes", "semantic_object", ()),), (*_PATHS, *more), (), _OUTPUTS)


def _homes(v: X.Snapshot, spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation = read_table(spark, sf_dir, "nation")
    identity = _uuid(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")))
    return {"homes": nation.select(identity.alias("root"), F.lit("semantic_object").alias("kind"), identity.alias("id"))}


_UNITS = "SELECT c.home_id AS root, u.object_id || '#' || u.address || '#' || u.ordinal::VARCHAR AS id, u.* FROM u JOIN c ON c.id = u.object_id"
_DATES = "SELECT c.home_id AS root, 'anchor:joined:' || i.object_id AS id, i.value FROM i JOIN c ON c.id = i.object_id WHERE identifier_name = 'joined'"
_HITS = f"SELECT root, id, position FROM (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY length(content) - length(replace(content, 'e', '')) DESC, id) AS position FROM ({_UNITS}) WHERE contains(content, 'e')) WHERE position <= 3"


@register("output_shapes", f"""{_CTE} SELECT 'object_ids' AS shape, NULL AS root, id, NULL AS detail FROM c
  UNION ALL SELECT 'unit_ids', NULL, id, NULL FROM ({_UNITS}) UNION ALL SELECT 'units', root, id, md5(content) FROM ({_UNITS})
  UNION ALL SELECT 'regions', home_id, object_id || '#' || address, address FROM g JOIN c ON c.id = g.object_id
  UNION ALL SELECT 'occurrence_paths', target_id, occurrence_id, source_object_id || '>' || target_id FROM x WHERE target_kind = 'semantic_object'
  UNION ALL SELECT 'anchors', root, id, value FROM ({_DATES})
  UNION ALL SELECT 'grouped_by_object', object_id, id, (row_number() OVER (PARTITION BY object_id ORDER BY id))::VARCHAR FROM ({_UNITS})
  UNION ALL SELECT 'ordered_evidence', root, id, (row_number() OVER (PARTITION BY root ORDER BY value, id))::VARCHAR FROM ({_DATES})
  UNION ALL SELECT 'exact_total', NULL, NULL, count(DISTINCT id)::VARCHAR FROM ({_UNITS})
  UNION ALL SELECT 'surface_provenance', root, id, unnest(['hits.1:lexical', 'links.1:-', 'people.1:-', 'units.1:-']) FROM ({_HITS})""")
def output_shapes(spark, sf_dir):
    """All ten shapes of the outputs of one plan."""
    snap, plan = snapshot(spark, sf_dir), _plan()
    out = X.execute(plan, snap, _homes(snap, spark, sf_dir))
    none = F.lit(None).cast("string")
    details = {
        "object_ids": (none, F.col("id"), none),
        "unit_ids": (none, F.col("id"), none),
        "units": (F.col("root"), F.col("id"), F.md5("content")),
        "regions": (F.col("root"), F.col("id"), F.col("address")),
        "occurrence_paths": (F.col("root"), F.col("id"), F.concat_ws(">", "source_id", "target_id")),
        "anchors": (F.col("root"), F.col("id"), F.col("anchor")),
        "grouped_by_object": (F.col("object_id"), F.col("id"), F.col("ordinal").cast("string")),
        "ordered_evidence": (F.col("root"), F.col("id"), F.col("ordinal").cast("string")),
        "exact_total": (none, none, F.col("total").cast("string")),
        "surface_provenance": (F.col("root"), F.col("id"), F.concat_ws(":", "operation_id", F.coalesce("surface_id", F.lit("-")))),
    }
    result = None
    for how, name in _OUTPUTS:
        rows = X.surface_provenance(out[name], plan, name) if how == "surface_provenance" else X.shape(out[name], how, snap)
        root, identity, detail = details[how]
        part = rows.select(F.lit(how).alias("shape"), root.alias("root"), identity.alias("id"), detail.alias("detail"))
        result = part if result is None else result.unionByName(part)
    return result


@register("plan_search_limit", f"{_CTE} SELECT root, id, position FROM ({_HITS})")
def plan_search_limit(spark, sf_dir):
    """The three best hits of each start, by the rank of the surface."""
    snap = snapshot(spark, sf_dir)
    return X.execute(_plan(), snap, _homes(snap, spark, sf_dir))["hits"].select("root", "id", "position")


_OBSERVED = f"""SELECT 'links.1' AS operation_id, true AS required, 'completed' AS status, (SELECT count(*) FROM x WHERE target_kind = 'semantic_object') AS observed UNION ALL SELECT 'people.1', true, 'completed', (SELECT count(*) FROM c)
  UNION ALL SELECT 'dates.1', true, 'completed', (SELECT count(*) FROM ({_DATES})) UNION ALL SELECT 'dates.2', true, 'completed', (SELECT count(*) FROM ({_DATES})) UNION ALL SELECT 'units.1', true, 'completed', (SELECT count(*) FROM ({_UNITS}))
  UNION ALL SELECT 'regions.1', true, 'completed', (SELECT count(*) FROM g JOIN c ON c.id = g.object_id)
  UNION ALL SELECT 'hits.1', true, CASE WHEN max(n) > 3 THEN 'truncated' ELSE 'completed' END, max(n) FROM (SELECT count(*) AS n FROM ({_UNITS}) WHERE contains(content, 'e') GROUP BY root)
  UNION ALL SELECT 'near.1', false, 'surface_unavailable', 0 UNION ALL SELECT 'none.1', true, 'completed_zero_matches', 0"""


def _more() -> tuple[X.Path, ...]:
    near = X.Search("vector", "nearest_neighbours", None, 5, required=False)
    return X.Path("units", (near,), "near"), X.Path("units", (X.Search("lexical", "terms", "not in any unit", 3),), "none")


@register("plan_operations", f"{_CTE} {_OBSERVED}")
def plan_operations(spark, sf_dir):
    """What each operation measured; an optional surface that is not there is a status, not an error."""
    snap = snapshot(spark, sf_dir)
    with Scratch(spark) as scratch:
        done = X.run(_plan(*_more()), snap, scratch, _homes(snap, spark, sf_dir))
    return Q.applied_statuses(done.operations).select("operation_id", "required", "status", "observed")


@register("vault_conformance", f"""{_CTE} SELECT 'unsupported_transition' AS code, 'object-nothing' AS subject UNION ALL SELECT 'unsupported_transition', 'unit-song' UNION ALL SELECT 'missing_relation', 'sings' UNION ALL SELECT 'direction_unavailable', 'region-unit'
  UNION ALL SELECT 'input_type_mismatch', 'unit-region' UNION ALL SELECT 'surface_unavailable', 'vector' UNION ALL SELECT 'configuration_bound_exceeded', 'lexical' UNION ALL SELECT 'identifier_not_applicable', 'joined'
  UNION ALL SELECT 'missing_address', 'semantic_object:' || {_id("'nation:' || c_custkey::VARCHAR")} FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)""")
def vault_conformance(spark, sf_dir):
    """Faults of plans on the vault: names that look like its transitions, and an address a customer that no note has."""
    snap = snapshot(spark, sf_dir)
    asked = read_table(spark, sf_dir, "customer").select(F.lit("homes").alias("root"), F.lit("semantic_object").alias("kind"), _uuid(F.concat(F.lit("nation:"), F.col("c_custkey").cast("string"))).alias("id"))
    wrong = [(X.Follow("object-nothing"),), (X.Follow("unit-song"),), (X.Follow("sings"),), (X.Follow("object-region"), X.Follow("region-unit", "incoming")), (X.Follow("unit-region"),)]
    wrong += [(X.Search("vector", "nearest_neighbours", None),), (X.Search("lexical", S.SURFACES["lexical"][0], "e", S.HARD_LIMIT + 1),), (X.Search("lexical", S.SURFACES["lexical"][0], "e", 1, "joined"),)]
    plan = X.Plan((X.Binding("homes", "semantic_object", ()),), tuple(X.Path("homes", ops, f"p{k}") for k, ops in enumerate(wrong)))
    return X.conform(plan, snap, {"homes": asked})


@register("plan_requirement_kinds", "SELECT * FROM (VALUES ('beyond_hard_limit', 'failed'), ('optional_missing', 'partial'), ('required_missing', 'failed'), ('whole', 'complete')) t(plan_id, status)")
def plan_requirement_kinds(spark, sf_dir):
    """Plan status by what is missing: required or optional surfaces, or a limit beyond the hard one."""
    snap = snapshot(spark, sf_dir)
    searches = {"whole": X.Search("lexical", "terms", "e"), "optional_missing": X.Search("vector", "nearest_neighbours", None, 5, required=False), "required_missing": X.Search("vector", "nearest_neighbours", None, 5), "beyond_hard_limit": X.Search("lexical", "terms", "e", S.HARD_LIMIT + 1)}
    result = None
    for name, op in searches.items():
        plan = X.Plan((X.Binding("homes", "semantic_object", ()),), (X.Path("homes", (X.Follow("object-unit"), op), "found"),))
        with Scratch(spark) as scratch:
            done = X.run(plan, snap, scratch, _homes(snap, spark, sf_dir))
        part = Q.applied_statuses(done.operations).withColumn("plan_id", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return Q.overall_status(result)


_BOUND = [("region", "r1", "address", "homes"), ("relation", "rel1", "path", "people"), ("relation", "rel1", "transition", "object-unit"), ("constraint", "con1", "operation", "hits.1"), ("open_tension", "ten1", "output", "dates"), ("region", "r2", "path", "people"), ("constraint", "con2", "operation", "hits.9"), ("open_tension", "ten2", "address", "nowhere")]


def _bindings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BOUND, "problem_kind string, problem_id string, bound_kind string, bound_id string")


@register("plan_provenance_faults", "SELECT problem_kind, problem_id || ':' || c_custkey::VARCHAR AS problem_id, bound_kind, bound_id, fault FROM customer, (VALUES ('region', 'r2', 'path', 'people', 'kind_not_bindable'), ('constraint', 'con2', 'operation', 'hits.9', 'not_in_plan'), ('open_tension', 'ten2', 'address', 'nowhere', 'not_in_plan')) t(problem_kind, problem_id, bound_kind, bound_id, fault)")
def plan_provenance_faults(spark, sf_dir):
    """Problem records of every customer that are bound to what the plan does not have."""
    records = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")).crossJoin(F.broadcast(_bindings(spark)))
    bound = records.withColumn("problem_id", F.concat_ws(":", "problem_id", "k")).drop("k")
    return X.provenance_faults(_plan(), bound).select("problem_kind", "problem_id", "bound_kind", "bound_id", "fault")


@register("plan_provenance_carried", f"{_CTE} SELECT root, id, unnest(['region', 'relation', 'constraint', 'region']) AS problem_kind, unnest(['r1', 'rel1', 'con1', 'r2']) AS problem_id FROM ({_HITS})")
def plan_provenance_carried(spark, sf_dir):
    """Hits with the problem records that led to them."""
    snap, plan = snapshot(spark, sf_dir), _plan()
    return X.carry_provenance(X.execute(plan, snap, _homes(snap, spark, sf_dir))["hits"], plan, "hits", _bindings(spark))


@register("join_temporal_branches", f"{_CTE} SELECT root, id, anchor, position, provenance FROM (SELECT root, id, value AS anchor, branch AS provenance, row_number() OVER (PARTITION BY root ORDER BY value, id) AS position FROM (SELECT d.*, CASE WHEN d.value < '2020-01-15' THEN 'early' ELSE 'late' END AS branch FROM ({_DATES}) d))")
def join_temporal_branches(spark, sf_dir):
    """Two branches of anchors of each nation merged to one sequence."""
    snap = snapshot(spark, sf_dir)
    v = X.execute(_plan(), snap, _homes(snap, spark, sf_dir))["dates"].select("root", "kind", "id", "anchor")
    plan = X.Plan((X.Binding("a", "temporal_anchor", ()), X.Binding("b", "temporal_anchor", ())), (X.Path("a", (), "early"), X.Path("b", (), "late")), (X.Join("temporal_order", ("early", "late"), "all"),))
    merged = X.execute(plan, snap, {"a": v.where("anchor < '2020-01-15'"), "b": v.where("anchor >= '2020-01-15'")})["all"]
    return merged.select("root", "id", "anchor", "position", "provenance")


@register("returned_unit_payload", f"""{_CTE} SELECT p.id AS unit_id, p.object_id, p.content, CASE WHEN contains(p.content, 'e') AND y.occurrences IS NOT NULL THEN 'a.1:lexical,b.1:-' WHEN contains(p.content, 'e') THEN 'a.1:lexical' ELSE 'b.1:-' END AS provenance,
  'class=customer' || coalesce(',joined=' || d.value, '') AS identifiers, d.value AS anchors, y.occurrences, greatest(ceil(length(p.content) / 16.0), 1)::BIGINT AS segments
  FROM ({_UNITS}) p LEFT JOIN (SELECT object_id, value FROM i WHERE identifier_name = 'joined') d ON d.object_id = p.object_id
  LEFT JOIN (SELECT source_unit_id, string_agg(occurrence_id, ',' ORDER BY occurrence_id) AS occurrences FROM x WHERE source_unit_id IS NOT NULL GROUP BY 1) y ON y.source_unit_id = p.id WHERE contains(p.content, 'e') OR y.occurrences IS NOT NULL""")
def returned_unit_payload(spark, sf_dir):
    """Units that two routes return, with content, identifiers, anchors, occurrences and segments."""
    v = vault(spark, sf_dir)
    people = v.units.join(v.objects.where("class_name = 'customer'").select("object_id"), "object_id", "left_semi")
    named = people.where(F.col("content").contains("e")).select("unit_id", F.lit("a.1").alias("operation_id"), F.lit("lexical").alias("surface_id"))
    linked = v.occurrences.where("source_unit_id is not null").select(F.col("source_unit_id").alias("unit_id"), F.lit("b.1").alias("operation_id"), F.lit(None).cast("string").alias("surface_id"))
    segments = P.transport_segments(v.units.select("object_id", "ordinal", "content"), 16)
    return Q.unit_payload(named.unionByName(linked), people, v.assignments, v.occurrences, v.anchors, segments)


@register("direct_counts", f"""{_CTE} SELECT o.object_id, (SELECT count(*) FROM g WHERE g.object_id = o.object_id) AS contained_regions, (SELECT count(*) FROM u WHERE u.object_id = o.object_id) AS contained_units, (SELECT count(*) FROM x WHERE source_object_id = o.object_id) AS outgoing,
  (SELECT count(*) FROM x WHERE target_kind = 'semantic_object' AND target_id = o.object_id) AS incoming, (SELECT count(*) FROM i WHERE i.object_id = o.object_id AND identifier_name = 'joined') AS anchors, (SELECT count(*) FROM i WHERE i.object_id = o.object_id) AS identifiers FROM o""")
def direct_counts(spark, sf_dir):
    """What hangs on every object, by kind."""
    v = vault(spark, sf_dir)
    return A.direct_counts(v.objects, S.transition_edges(v))


@register("hub_type_counts", f"{_CTE} SELECT target_id AS origin, 'object-occurrence-incoming' AS transition_id, 'incoming' AS direction, 'customer' AS class_name, count(*) AS links FROM x WHERE target_kind = 'semantic_object' GROUP BY target_id HAVING count(*) > 5")
def hub_type_counts(spark, sf_dir):
    """Incoming links of nations that have many, by relation and class of the source."""
    v = vault(spark, sf_dir)
    edges = S.transition_edges(v).where("transition_id = 'object-occurrence-incoming'").join(v.occurrences.select(F.col("occurrence_id").alias("target_id"), F.col("source_object_id").alias("other_id")), "target_id")
    classes = v.objects.select(F.col("object_id").alias("other_id"), "class_name")
    return A.hub_counts(edges.select(F.col("source_id").alias("origin"), "transition_id", "direction", "other_id"), classes, 5)


@register("filter_identifier", f"{_CTE} SELECT object_id, 'joined' AS identifier_name, value FROM i WHERE identifier_name = 'joined' AND value = '2020-01-02'")
def filter_identifier(spark, sf_dir):
    """Assignments of one identifier with one value."""
    return vault(spark, sf_dir).assignments.where(A.filter_of("identifier", ("joined", "2020-01-02"))).select("object_id", "identifier_name", "value")


@register("default_provenance", f"{_CTE} SELECT object_id, 'configured_default:bounded_structural_context' AS provenance FROM o WHERE class_name = 'nation'")
def default_provenance(spark, sf_dir):
    """Objects that a configured default brings into a view."""
    return A.with_default(vault(spark, sf_dir).objects.where("class_name = 'nation'").select("object_id"), "bounded_structural_context")


_HITS_OF = "SELECT c.home_id AS turn_id, u.object_id || '#' || u.address || '#' || u.ordinal::VARCHAR AS id, length(content) - length(replace(content, 'e', '')) AS score FROM u JOIN c ON c.id = u.object_id WHERE contains(content, 'e')"


@register("expansion_kinds", f"""{_CTE},
  s AS (SELECT turn_id, id, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, id) AS ord FROM ({_HITS_OF}))
  SELECT 'incoming_occurrences' AS kind, target_id AS turn_id, occurrence_id AS id, 0 AS ord FROM x WHERE target_kind = 'semantic_object'
  UNION ALL SELECT 'contained', id, id || '#' || unnest(['root', 'Facts', 'Facts#1']), 0 FROM n UNION ALL SELECT 'identifier_assignments', id, 'id:' || id || ':class', 0 FROM n
  UNION ALL SELECT 'outgoing_occurrences', c.home_id, x.occurrence_id, 0 FROM x JOIN c ON c.id = x.source_object_id
  UNION ALL SELECT 'temporal_incidence', c.home_id, 'anchor:joined:' || c.id, 0 FROM c WHERE k % 3 = 0
  UNION ALL SELECT DISTINCT 'graph_neighbours', c.home_id, unnest(list_distinct(list_filter([x.target_id, x.source_object_id, x.source_unit_id], lambda y: y IS NOT NULL))), 0 FROM x JOIN c ON c.id = x.source_object_id WHERE x.source_unit_id IS NULL
  UNION ALL SELECT kind, turn_id, id, ord FROM s, (VALUES ('exact_matches'), ('lexical_candidates'), ('vector_candidates')) t(kind) WHERE ord <= 4""")
def expansion_kinds(spark, sf_dir):
    """What a request of each kind but a further page finds."""
    v = vault(spark, sf_dir)
    edges = S.transition_edges(v)
    homes = v.objects.where("class_name = 'nation'").select(F.col("object_id").alias("turn_id"), F.lit("semantic_object").alias("kind"), F.col("object_id").alias("id"), F.lit(0).cast("long").alias("ord"))
    front = v.occurrences.where("source_unit_id is null and status = 'resolved'")
    people = front.select(F.col("target_id").alias("turn_id"), F.lit("semantic_object").alias("kind"), F.col("source_object_id").alias("id"), F.lit(0).cast("long").alias("ord"))
    links = front.select(F.col("target_id").alias("turn_id"), F.lit("occurrence").alias("kind"), F.col("occurrence_id").alias("id"), F.lit(0).cast("long").alias("ord"))
    units = v.units.withColumn("score", F.length("content") - F.length(F.replace(F.col("content"), F.lit("e"), F.lit("")))).where("score > 0")

    def search(request: DataFrame) -> DataFrame:
        found = request.select("turn_id", F.col("id").alias("object_id")).join(units, "object_id").select("turn_id", F.col("unit_id").alias("id"), "score")
        return R.top(found, "turn_id", [F.desc("score"), "id"], 4, "position")

    requests = {"incoming_occurrences": homes, "contained": homes, "identifier_assignments": homes, "outgoing_occurrences": people, "temporal_incidence": people, "graph_neighbours": links, "exact_matches": people, "lexical_candidates": people, "vector_candidates": people}
    parts = [A.expansion(kind, request, edges, search).withColumn("kind", F.lit(kind)) for kind, request in requests.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("kind", "turn_id", "id", F.col("ord").cast("int").alias("ord"))


@register("expansion_page", f"{_CTE} SELECT turn_id, id, ord FROM (SELECT turn_id, id, row_number() OVER (PARTITION BY turn_id ORDER BY id) - 1 AS ord FROM (SELECT object_id AS turn_id, object_id || '#' || unnest(['root', 'Facts', 'Facts#1']) AS id FROM o WHERE class_name = 'nation' UNION ALL SELECT object_id, 'id:' || object_id || ':class' FROM o WHERE class_name = 'nation' UNION ALL SELECT target_id, occurrence_id FROM x WHERE target_kind = 'semantic_object')) WHERE ord BETWEEN 2 AND 5")
def expansion_page(spark, sf_dir):
    """A further page of all neighbours of each nation."""
    v = vault(spark, sf_dir)
    homes = v.objects.where("class_name = 'nation'").select(F.col("object_id").alias("turn_id"), F.lit("semantic_object").alias("kind"), F.col("object_id").alias("id"), F.lit(0).cast("long").alias("ord"))
    return A.expansion(A.CONTINUATION, homes, S.transition_edges(v), offset=2, limit=4)
