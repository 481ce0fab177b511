"""Activation: bounded, explainable views of a projection.

Every step is a set operation over ordered rows. Whether an atomic bundle still fits
depends on all bundles before it; the bundles of a short turn are placed in order in one
row, those of a long one in rounds, each of which settles all that surely fit or surely do not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.operators import traversal as T
from quillstrata.sources import Scratch

#: Order of seed groups.
SEED_GROUPS = ("utterance", "whole_space_constraint", "primary", "secondary", "tertiary", "background", "configured_default")
#: Default provenance keys.
DEFAULTS = ("automatic_surface_fan_out", "bounded_structural_context", "high_degree_summary")
#: Match modes that each kind of probe may use.
PROBE_MODES = {"text": ("literal", "terms", "nearest_neighbours"), "address": ("incidence",), "temporal": ("temporal",)}


def config_faults(config: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Return (surface_id, fault): missing, repeated, unknown or excessive configuration."""
    per = config.groupBy("surface_id").agg(F.count("*").alias("times"), F.max("candidate_limit").alias("candidate_limit"))
    both = surfaces.where("available").select("surface_id", "hard_limit").join(per, "surface_id", "full_outer")
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("hard_limit").isNull(), "unknown_surface").when(F.col("times") > 1, "repeated").when(F.col("candidate_limit") > F.col("hard_limit"), "above_hard_limit").when(F.col("candidate_limit") < 0, "negative")
    return both.select("surface_id", fault.alias("fault")).where("fault is not null")


def order_seeds(families: dict[str, DataFrame]) -> DataFrame:
    """Number the seeds of each turn: groups in their fixed order, then lens, family and item order.

    Each family has turn_id, lens_ord, family_ord, item_ord and text.
    """
    parts = [rows.select("turn_id", F.lit(SEED_GROUPS.index(name)).cast("long").alias("group_ord"), F.lit(name).alias("seed_group"), "lens_ord", "family_ord", "item_ord", "text") for name, rows in families.items()]
    rank = F.row_number().over(Window.partitionBy("turn_id").orderBy("group_ord", "lens_ord", "family_ord", "item_ord"))
    return reduce(DataFrame.unionByName, parts).withColumn("seed_ord", rank.cast("long"))


def bound_seeds(seeds: DataFrame, maximum: int) -> DataFrame:
    """Keep the first seeds of each turn, before they fan out."""
    return seeds.where(F.col("seed_ord") <= maximum)


def dispatch(seeds: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Send each seed to every available surface and each mode it declares for that kind of probe.

    ``surfaces`` has surface_id, surface_ord, available and match_modes; it is a
    small catalogue. Probe ids follow seed, surface and mode.
    """
    allowed = F.create_map(*(x for kind, modes in PROBE_MODES.items() for x in (F.lit(kind), F.array(*map(F.lit, modes)))))
    modes = surfaces.where("available").select("surface_id", "surface_ord", F.posexplode("match_modes").alias("mode_ord", "mode"))
    probes = seeds.join(F.broadcast(modes), F.array_contains(allowed[F.col("probe_kind")], F.col("mode")))
    rank = F.row_number().over(Window.partitionBy("turn_id").orderBy("seed_ord", "surface_ord", "mode_ord")) - 1
    return probes.select("turn_id", "seed_ord", "surface_id", "mode", F.concat(F.lit("activation-probe:"), rank).alias("probe_id"))


def cap(candidates: DataFrame, probe: list[str], order: list, limit: Column | int, rank: str = "position", most: int | None = None) -> DataFrame:
    """Keep the first candidates of each probe, with how many there were and whether any were cut.

    Candidates are counted by a combining aggregate, and ranks beyond the limit are cut
    before the shuffle; where the limit is a column, ``most`` names the greatest it can be.
    """
    observed = candidates.groupBy(*probe).agg(F.count("*").alias("observed"))
    position = F.row_number().over(Window.partitionBy(*probe).orderBy(*order))
    ranked = candidates.withColumn(rank, position)
    if most is not None or isinstance(limit, int):
        ranked = ranked.where(F.col(rank) <= (limit if most is None else most))
    limit = F.lit(limit) if isinstance(limit, int) else limit
    state = F.when(F.col("observed") > limit, "bounded").otherwise("complete")
    kept = ranked.where(F.col(rank) <= limit).withColumn(rank, F.col(rank).cast("long"))
    return kept.join(observed, probe).withColumn("truncation", state)


def preview(text: Column, limit: int) -> Column:
    """First code points of a normalized text; none where only an address is held."""
    return F.when(text.isNull(), F.struct(F.lit("unavailable").alias("state"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("truncated"))).otherwise(F.struct(F.lit("available").alias("state"), F.substring(text, 1, limit).alias("text"), (F.char_length(text) > limit).alias("truncated")))


def closure(found: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """Add everything above found records (turn_id, id, ord): units to regions to objects.

    ``parents`` has id and parent; a parent takes the first position that needs it.
    """
    layers = [found.select("turn_id", "id", "ord")]
    for _ in range(depth):
        layers.append(layers[-1].join(parents, "id").select("turn_id", F.col("parent").alias("id"), "ord").groupBy("turn_id", "id").agg(F.min("ord").alias("ord")))
    return reduce(DataFrame.unionByName, layers).groupBy("turn_id", "id").agg(F.min("ord").alias("ord"))


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row an identity at its first position, with distinct provenance in order of appearance."""
    ordered = rows.groupBy(*keys, "provenance").agg(F.min("ord").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "provenance")))
    return ordered.groupBy(*keys).agg(F.min("at").alias("ord"), F.array_join(F.transform(listed, lambda x: x["provenance"]), ",").alias("provenance"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row of each (source, transition, direction, target), numbered by first insertion."""
    keys = ["turn_id", "source_id", "transition_id", "direction", "target_id"]
    once = edges.groupBy(*keys).agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("turn_id").orderBy("ord", *keys[1:])) - 1
    return once.select(*keys, F.concat(F.lit("activated-edge:"), rank).alias("edge_id"))


def telemetry(candidates: DataFrame) -> DataFrame:
    """Counts of each probe, surface and mode, numbered in first-seen order."""
    keys = ["turn_id", "probe_ord", "surface_id", "mode"]
    counts = candidates.groupBy(*keys).agg(F.count("*").alias("candidates"))
    rank = F.row_number().over(Window.partitionBy("turn_id").orderBy(*keys[1:])) - 1
    return counts.withColumn("telemetry_id", F.concat(F.lit("activation-telemetry:"), rank))


def labels(records: DataFrame, label: str) -> DataFrame:
    """Count records by label."""
    return records.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("records"))


def degrees(records: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Number of distinct direct edges of every record, zero included."""
    counted = edges.groupBy(key).agg(F.count_distinct("transition_id", "direction", "target_id").alias("degree"))
    return records.join(counted, key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree"))


#: Direct counts of an object, by the transition that they count.
COUNTED = {"object-region": "contained_regions", "object-unit": "contained_units", "object-occurrence-outgoing": "outgoing", "object-occurrence-incoming": "incoming", "temporal-anchor": "anchors", "identifier": "identifiers"}


def direct_counts(objects: DataFrame, edges: DataFrame, key: str = "object_id") -> DataFrame:
    """Contained, outgoing, incoming and dated records of every object, zeros included."""
    counts = [F.count(F.when(F.col("transition_id") == t, 1)).alias(name) for t, name in COUNTED.items()]
    counted = edges.where(F.col("transition_id").isin(*COUNTED)).groupBy(F.col("source_id").alias(key)).agg(*counts)
    joined = objects.select(key).join(counted, key, "left")
    return joined.select(key, *(F.coalesce(name, F.lit(0)).alias(name) for name in COUNTED.values()))


def hub_counts(edges: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Return (origin, transition_id, direction, class_name, links) of origins with more than ``least`` edges.

    ``edges`` has origin, transition_id, direction and other_id, ``classes`` (other_id,
    class_name): what a hub shows instead of its neighbours.
    """
    hubs = edges.groupBy("origin").count().where(F.col("count") > least).select("origin")
    typed = edges.join(hubs, "origin", "left_semi").join(classes, "other_id", "left")
    return typed.groupBy("origin", "transition_id", "direction", "class_name").agg(F.count("*").alias("links"))


def page(rows: DataFrame, origin: str, order: list, offset: int, limit: int) -> DataFrame:
    """One page of each origin's rows, with the next offset and how many remain.

    A limit of 0 gives no page; next_offset is null on the last one. Rows are counted by a
    combining aggregate, and ranks beyond the page are cut before the shuffle.
    """
    end = offset + limit
    total = rows.groupBy(origin).agg(F.count("*").alias("total"))
    position = F.row_number().over(Window.partitionBy(origin).orderBy(*order))
    shown = rows.withColumn("position", position).where(F.col("position") <= end).where(F.col("position") > offset)
    remaining = F.greatest(F.col("total") - end, F.lit(0))
    shown = shown.withColumn("position", F.col("position").cast("long") - 1).join(total, origin)
    return shown.withColumn("remaining", remaining).withColumn("next_offset", F.when(remaining > 0, F.lit(end).cast("long"))).drop("total")


def continue_page(rows: DataFrame, handle: dict, snapshot_id: str) -> DataFrame:
    """The page that a continuation handle describes; one of another snapshot is an error."""
    if handle["projection_snapshot_id"] != snapshot_id:
        raise ValueError("stale continuation handle")
    for name, value in handle.get("filters", {}).items():
        rows = rows.where(filter_of(name, value))
    origin = rows.where(F.col(handle["origin_field"]) == handle["origin"])
    return page(origin, handle["origin_field"], handle["ordering"], handle["next_offset"], handle["page_limit"])


def filter_of(name: str, value: object) -> Column:
    """Predicate of a continuation filter; an identifier is a pair of its name and value."""
    if name == "identifier":
        return (F.col("identifier_name") == value[0]) & (F.col("value") == value[1])
    if name == "path_prefix":
        return F.col("path").startswith(value)
    if name == "temporal_range":
        start, end = value
        lower = F.lit(True) if start is None else F.col("anchor") >= start
        return lower if end is None else lower & (F.col("anchor") <= end)
    if name in ("transition_id", "direction", "object_class", "surface_id"):
        return F.col(name) == value
    raise KeyError(f"continuation filter {name} is not supported")


#: Needs of a turn up to which one row holds its bundles; those of longer turns are spread over tasks.
TURN_NEEDS = 1024


def place_bundles(bundles: DataFrame, limits: dict[str, int], scratch: Scratch) -> DataFrame:
    """Place the atomic bundles of each turn in order; one that does not fit is left out whole.

    ``bundles`` has turn_id, bundle_ord, kind and id: all records a bundle needs.
    Records that an earlier bundle brought are shared and cost nothing. Returns
    (turn_id, bundle_ord, placed, added); a null turn is a turn, and kinds without a limit
    are not bound.

    Turns with at most ``TURN_NEEDS`` needs are gathered to a row each and placed bundle by
    bundle, all in one pass; longer ones are placed in rounds, and none of them is one task's.
    """
    turn = "turn_id"

    def told(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))

    need = scratch.write(bundles.select(told(turn).alias(turn), F.col("bundle_ord").cast("long").alias("bundle_ord"), told("kind").alias("kind"), told("id").alias("id")))
    bounds = {f"={kind}": most for kind, most in limits.items()}
    long_ = scratch.write(need.groupBy(turn).agg(F.count("*").alias("needs")).where(F.col("needs") > TURN_NEEDS).select(turn))
    if long_.isEmpty():
        rows = _place_in_order(need, bounds)
    else:
        rows = _place_in_order(need.join(long_, turn, "left_anti"), bounds).unionByName(_place_in_rounds(need.join(long_, turn, "left_semi"), bounds, scratch))
    return rows.withColumn(turn, F.when(F.col(turn) != "", F.substring(turn, 2, 1 << 30)))


def _place_in_order(need: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Place the bundles of turns of bounded length; each turn is dealt to a task once."""
    kind = F.concat(F.char_length("kind").cast("string"), F.lit(":"), "kind")
    items = need.select("turn_id", "bundle_ord", F.concat(kind, "id").alias("item")).repartition("turn_id").groupBy("turn_id", "bundle_ord").agg(F.collect_set("item").alias("items"))
    turns = items.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("bundle_ord", "items"))).alias("bundles"))

    def count(records: Column, kind: str) -> Column:
        return F.size(F.filter(records, lambda x: x.startswith(f"{len(kind)}:{kind}")))

    def place(so_far: Column, bundle: Column) -> Column:
        def judged(both: Column) -> Column:
            fits = reduce(lambda a, b: a & b, (count(both, kind) <= most for kind, most in limits.items()), F.lit(True))
            added = F.when(fits, F.size(both) - F.size(so_far["held"])).otherwise(0).cast("long")
            done = F.concat(so_far["done"], F.array(F.struct(bundle["bundle_ord"].alias("bundle_ord"), fits.alias("placed"), added.alias("added"))))
            return F.struct(F.when(fits, both).otherwise(so_far["held"]).alias("held"), done.alias("done"))

        # A list of one, so that the union is made once.
        return F.transform(F.array(F.array_union(so_far["held"], bundle["items"])), judged)[0]

    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<struct<bundle_ord:bigint,placed:boolean,added:bigint>>").alias("done"))
    return turns.select("turn_id", F.inline(F.aggregate("bundles", start, place, lambda x: x["done"])))


def _place_in_rounds(bundles: DataFrame, limits: dict[str, int], scratch: Scratch) -> DataFrame:
    """Place the bundles of turns of any length.

    What is held only grows, and so does its union with a bundle: a bundle that does not fit
    now never will. In a round all such bundles are settled at once, and of the others the
    longest row from the first on that fits together; the one after it does not fit, since
    all before it are placed. No turn is one task's: sums over a turn's bundles are taken by
    ranges. Rounds go on until all bundles are settled; each places a bundle of every turn
    that has an open one, or leaves it without.
    """
    most = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else F.create_map().cast("map<string, int>")
    bound = F.coalesce(most[F.col("kind")], F.lit(2**62)).cast("long")
    turn, turns = "turn_id", ["turn_id", "bundle_ord"]
    need = scratch.write(bundles.distinct())
    open_ = scratch.write(need.select(turns).distinct())
    held = need.where("false").select(turn, "kind", "id")
    settled: list[DataFrame] = []
    while not open_.isEmpty():
        wanted = need.join(open_, turns, "left_semi").join(held, [turn, "kind", "id"], "left_anti")
        full = held.groupBy(turn, "kind").agg(F.count("*").alias("held"))
        # Alone with what is held.
        alone = wanted.groupBy(*turns, "kind").agg(F.count("*").alias("new")).join(full, [turn, "kind"], "left")
        over = scratch.write(alone.where(F.col("new") + F.coalesce("held", F.lit(0)) > bound).select(turns).distinct())
        still = open_.join(over, turns, "left_anti")
        # Each record counts for the first open bundle that needs it.
        first = wanted.join(over, turns, "left_anti").groupBy(turn, "kind", "id").agg(F.min("bundle_ord").alias("bundle_ord"))
        new = scratch.write(first)
        sums = T.running_sum(new.groupBy(turn, "kind", "bundle_ord").agg(F.count("*").alias("new")), [turn, "kind"], "bundle_ord", "new", scratch)
        bad = sums.join(full, [turn, "kind"], "left").where(F.col("sum") + F.coalesce("held", F.lit(0)) > bound).groupBy(turn).agg(F.min("bundle_ord").alias("bad"))
        judged = scratch.write(still.join(bad, turn, "left").withColumn("placed", F.col("bad").isNull() | (F.col("bundle_ord") < F.col("bad"))))
        placed = judged.where("placed").select(turns)
        added = new.join(placed, turns, "left_semi")
        counts = added.groupBy(turns).agg(F.count("*").alias("added"))
        here = placed.join(counts, turns, "left").select(*turns, F.lit(True).alias("placed"), F.coalesce("added", F.lit(0)).alias("added"))
        never = over.unionByName(judged.where("bundle_ord = bad").select(turns)).select(*turns, F.lit(False).alias("placed"), F.lit(0).cast("long").alias("added"))
        settled.append(scratch.write(here.unionByName(never)))
        held = scratch.write(held.unionByName(added.select(turn, "kind", "id")))
        open_ = scratch.write(judged.where("bundle_ord > bad").select(turns))
    return reduce(DataFrame.unionByName, settled) if settled else open_.select(*turns, F.lit(True).alias("placed"), F.lit(0).cast("long").alias("added"))


def expand(view: DataFrame, found: DataFrame, budget: int) -> DataFrame:
    """Add new records to a view under a hard budget for each turn.

    Returns (turn_id, id, ord, state): rows of the view stay, new ones follow in
    order; state says whether the budget cut any.
    """
    new = found.join(view.select("turn_id", "id"), ["turn_id", "id"], "left_anti").groupBy("turn_id", "id").agg(F.min("ord").alias("ord"))
    kept = cap(new, ["turn_id"], ["ord", "id"], budget, "rank")
    state = F.when(F.col("observed") > budget, "budget_exhausted").otherwise("complete")
    return view.select("turn_id", "id", "ord", F.lit("complete").alias("state")).unionByName(kept.select("turn_id", "id", "ord", state.alias("state")))


#: Expansions that follow transitions: (transition, direction) of each.
EXPANSIONS = {
    "incoming_occurrences": (("object-occurrence-incoming", "incoming"), ("region-occurrence-incoming", "incoming"), ("unit-occurrence-incoming", "incoming")),
    "outgoing_occurrences": (("object-occurrence-outgoing", "outgoing"), ("unit-occurrence-outgoing", "outgoing")),
    "contained": (("object-region", "outgoing"), ("object-unit", "outgoing"), ("region-unit", "outgoing")),
    "identifier_assignments": (("identifier", "outgoing"),),
    "graph_neighbours": (("occurrence-object-target", "outgoing"), ("occurrence-region-target", "outgoing"), ("occurrence-unit-target", "outgoing"), ("occurrence-object-source", "incoming"), ("occurrence-unit-source", "incoming")),
    "temporal_incidence": (("temporal-anchor", "outgoing"),),
}
#: Expansions that search a surface, and the one that continues a page.
SEARCHES, CONTINUATION = ("exact_matches", "lexical_candidates", "vector_candidates"), "continued_page"


def expansion(kind: str, request: DataFrame, edges: DataFrame | None = None, search: Callable[[DataFrame], DataFrame] | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """Return (turn_id, id, ord) that a typed request finds, for ``expand`` to add.

    ``request`` has turn_id, kind, id and ord. Transitions are followed in ``edges``; ``search``
    gives (turn_id, id, position) of a surface; a continued page is the edges of each
    requested record from ``offset`` on. An unknown kind is an error.
    """
    if kind in SEARCHES:
        return search(request).select("turn_id", "id", F.col("position").cast("long").alias("ord"))
    if kind != CONTINUATION and kind not in EXPANSIONS:
        raise KeyError(f"expansion {kind} is not supported")
    allowed = [pair for pairs in EXPANSIONS.values() for pair in pairs] if kind == CONTINUATION else EXPANSIONS[kind]
    fits = reduce(lambda a, b: a | b, ((F.col("transition_id") == t) & (F.col("direction") == d) for t, d in allowed))
    origin = request.select("turn_id", F.col("kind").alias("source_kind"), F.col("id").alias("source_id"), F.col("ord").alias("asked"))
    found = origin.join(edges.where(fits), ["source_kind", "source_id"])
    if kind == CONTINUATION:
        rows = found.select("turn_id", F.struct("turn_id", "source_id").alias("origin"), F.col("target_id").alias("id")).distinct()
        return page(rows, "origin", ["id"], offset, limit).select("turn_id", "id", F.col("position").alias("ord"))
    return found.groupBy("turn_id", F.col("target_id").alias("id")).agg(F.min("asked").alias("ord"))


def with_default(rows: DataFrame, key: str) -> DataFrame:
    """Mark rows with the configured default that brought them."""
    if key not in DEFAULTS:
        raise KeyError(f"configured default {key} is not known")
    return rows.withColumn("provenance", F.lit(f"configured_default:{key}"))


def all_or_nothing(surfaces_ok: dict[str, bool], view: DataFrame) -> DataFrame:
    """Return the view only if no surface failed."""
    failed = sorted(name for name, ok in surfaces_ok.items() if not ok)
    if failed:
        raise RuntimeError(f"activation failed on {', '.join(failed)}")
    return view
