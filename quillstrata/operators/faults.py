"""Faults planted in a vault: each breaks one acceptance condition and no other.

Record faults are planted once for every key of a table, so that they grow with it; the
faults of catalogues and of the activated view are single ones.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import projection as P
from quillstrata.operators import structure as S


@dataclass
class Planted:
    """A vault with faults, and what its acceptance is given besides."""

    vault: S.Vault
    view: DataFrame
    incoming: DataFrame
    segments: DataFrame


def _identity(what: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{what}:"), "key"))
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def plant(v: S.Vault, keys: DataFrame, per_kind: int) -> Planted:
    """Plant a fault of every condition, record faults for each ``key`` of ``keys``.

    The view shows ``per_kind`` records of each kind of the vault with its faults.
    """

    def named(prefix: str) -> Column:
        return F.concat(F.lit(prefix), "key")

    def rows(**columns: Column) -> DataFrame:
        return keys.select(*(value.alias(name) for name, value in columns.items()))

    def add(table: DataFrame, *parts: DataFrame) -> DataFrame:
        for part in parts:
            table = table.unionByName(part.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in part.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields)))
        return table

    def host(what: str, n_units: int) -> DataFrame:
        return rows(object_id=_identity(what), title=named(f"{what} "), class_name=F.lit("nation"), n_units=F.lit(n_units))

    def root(what: str) -> DataFrame:
        return rows(object_id=_identity(what), address=F.lit(P.ROOT), ordinal=F.lit(0), level=F.lit(0), region_id=F.concat_ws("#", _identity(what), F.lit(P.ROOT)))

    def unit(what: str, ordinal: int, unit_id: Column, region_id: Column) -> DataFrame:
        return rows(unit_id=unit_id, object_id=_identity(what), region_id=region_id, ordinal=F.lit(ordinal), block_type=F.lit("paragraph"), content=F.lit("planted"), block_id=F.lit(""))

    def link(what: str, target: Column, **more: Column) -> DataFrame:
        return rows(occurrence_id=named(f"occ:{what}:"), source_object_id=_identity("06"), target=named("06 "), embed=F.lit(False), status=F.lit("resolved"), target_kind=F.lit("semantic_object"), target_id=target, **more)

    def place(what: str) -> Column:
        return F.concat_ws("#", _identity(what), F.lit(P.ROOT))

    objects = add(
        v.objects,
        rows(object_id=named("not a uuid:"), title=named("01 "), class_name=F.lit("nation"), n_units=F.lit(0)),
        rows(object_id=_identity("02"), title=_identity("02"), class_name=F.lit("nation"), n_units=F.lit(0)),
        host("03", 0),
        host("04", 2),
        host("05", 1),
        host("06", 3),
        host("14", 1),
    )
    units = add(v.units, unit("04", 1, named("twice:"), place("04")), unit("04", 2, named("twice:"), place("04")), unit("05", 1, named("lost:"), named("nowhere:")), unit("14", 1, named("cut:"), place("14")))
    occurrences = add(v.occurrences, link("09", named("gone:")), link("10", _identity("06")), link("11", _identity("06"), heading=F.lit("Facts")), link("12", _identity("06"), block_id=F.lit("b")))
    assignments = add(v.assignments, rows(identifier_name=F.lit("class"), object_id=_identity("06"), value=F.lit("nation"), assignment_id=named("id:07:")))
    anchors = add(v.anchors, rows(anchor_id=named("anchor:13:"), object_id=named("nobody:"), value=F.lit("2020-01-01")))
    kind = F.col("kind")
    surfaces = v.surfaces.withColumns(
        {
            "visible_kinds": F.when(kind == "exact", F.array_remove("visible_kinds", "identifier")).when(kind == "graph", F.array(*map(F.lit, S.KINDS))).otherwise(F.col("visible_kinds")),
            "default_limit": F.when(kind == "lexical", F.col("hard_limit") + 1).otherwise(F.col("default_limit")),
            "coverage": F.when(kind == "temporal", "exhaustive").otherwise(F.col("coverage")),
        }
    )
    broken = replace(v, objects=objects, regions=add(v.regions, root("03"), root("03"), root("04"), root("14")), units=units, occurrences=occurrences, assignments=assignments, anchors=anchors, surfaces=surfaces, transitions=v.transitions.where("transition_id <> 'identifier'"))
    incoming = S.listed_incoming(broken).where(~F.col("occurrence_id").startswith("occ:10:"))
    segments = P.transport_segments(units.select("object_id", "ordinal", "content"), S.SEGMENT).join(rows(object_id=_identity("14")), "object_id", "left_anti")
    return Planted(broken, _view(S.activate(broken, per_kind)), incoming, segments)


def _view(view: DataFrame) -> DataFrame:
    """A view with one record without provenance, one that is left out, one total that is wrong and one record that is made up."""
    first = view.groupBy("kind").agg(F.min("id").alias("first"))
    marked = view.join(F.broadcast(first), "kind").withColumn("at", (F.col("id") == F.col("first")))
    kind, at = F.col("kind"), F.col("at")
    shown = marked.where(~(at & (kind == "occurrence")))
    return shown.withColumns(
        {
            "provenance": F.when(~(at & (kind == "semantic_object")), F.col("provenance")),
            "total": F.when(kind == "semantic_region", F.col("total") - 1).otherwise(F.col("total")),
            "id": F.when(at & (kind == "identifier"), F.lit("made up")).otherwise(F.col("id")),
        }
    ).drop("first", "at")
