"""Maintenance of a projection: what a change of notes touches is built again, all else stays.

A note's objects, regions, units, assignments and anchors depend on the note alone. Its
links depend on the names, headings and block ids of other notes as well: a link is
resolved again if the name it asks for is one that a changed note has or had. Incoming
lists follow the links that came to another target. ``names`` finds the objects of a
name, ``mentions`` the notes whose links ask for one; with these two a change reads the
buckets it concerns, and the buckets whose rows differ are written, nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import structure as S
from quillstrata.sources import Scratch
from quillstrata.sources.buckets import Buckets

#: Tables by the key of their buckets.
KEYS = {"notes": "object_id", "objects": "object_id", "regions": "object_id", "units": "object_id", "assignments": "object_id", "anchors": "object_id", "occurrences": "source_object_id", "incoming": "target_object_id", "names": "name", "mentions": "name"}
OWN = ("notes", "objects", "regions", "units", "assignments", "anchors")
_CONTENT = ("title", "class_name", "front_matter", "front_lists", "body")


def _names(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("title").alias("name"), F.col("object_id").alias("target_id"))


def _mentions(links: DataFrame) -> DataFrame:
    return links.select(F.col("target").alias("name"), "source_object_id").distinct()


def _incoming(occurrences: DataFrame) -> DataFrame:
    """One row for each link that reaches a record, by the object that has the record."""
    reached = occurrences.where("status = 'resolved'")
    return reached.select(F.substring_index("target_id", "#", 1).alias("target_object_id"), "target_kind", "target_id", "occurrence_id", "source_object_id")


def start(store: Buckets, notes: DataFrame, descriptors: DataFrame) -> None:
    """Write the first version of a projection of ``notes``."""
    own = S.own_tables(notes, descriptors)
    names = _names(notes)
    with Scratch(notes.sparkSession) as scratch:
        occurrences = scratch.write(S.resolved_links(S.authored_links(notes, own["units"]), names, own["units"], own["regions"]))
        tables = {"notes": notes, **own, "occurrences": occurrences, "incoming": _incoming(occurrences), "names": names, "mentions": _mentions(occurrences)}
        store.commit({name: (rows, None) for name, rows in tables.items()})


def apply(store: Buckets, written: DataFrame, removed: DataFrame, descriptors: DataFrame) -> None:
    """Write the next version: notes in ``written`` are new or replace those of their id, ids in ``removed`` go.

    A note that is written again as it was changes nothing.
    """
    with Scratch(store.spark) as scratch:
        new, ids = _changed(store, written, removed, scratch)
        buckets = store.of(ids)
        if not buckets:
            return
        old = scratch.write(store.read("notes", buckets).join(ids, "object_id", "left_semi"))
        own = {"notes": new} | {name: scratch.write(rows) for name, rows in S.own_tables(new, descriptors).items()}

        def replaced(table: str, key: str, rows: DataFrame, gone: DataFrame, among: list[int]) -> tuple[DataFrame, list[int]]:
            """The rows of some buckets without those whose key is gone, and with new ones."""
            return store.read(table, among).join(gone, key, "left_anti").unionByName(rows), among

        changes = {name: replaced(name, "object_id", own[name], ids, buckets) for name in OWN}

        # Links of changed notes, and links of other notes that ask for a name which a changed note has or had.
        touched = scratch.write(old.select(F.col("title").alias("name")).unionByName(new.select(F.col("title").alias("name"))).distinct())
        askers = scratch.write(store.read("mentions", store.of(touched)).join(touched, "name", "left_semi").select(F.col("source_object_id").alias("object_id")).distinct().join(ids, "object_id", "left_anti"))
        source = F.col("source_object_id") == F.col("object_id")
        before = scratch.write(store.read("occurrences", buckets).join(ids, source, "left_semi"))
        asked = scratch.write(store.read("occurrences", store.of(askers)).join(askers, source, "left_semi").join(touched, F.col("target") == F.col("name"), "left_semi"))
        authored = S.authored_links(new, own["units"])
        open_links = scratch.write(authored.unionByName(asked.select(authored.columns)))
        wanted = scratch.write(open_links.select(F.col("target").alias("name")).distinct())
        gone_names = ids.withColumnRenamed("object_id", "target_id")
        names = scratch.write(store.read("names", store.of(wanted)).join(gone_names, "target_id", "left_anti").unionByName(_names(new)).join(wanted, "name", "left_semi"))
        targets = names.select(F.col("target_id").alias("object_id")).distinct()
        among = store.of(targets)
        places = [store.read(name, among).join(ids, "object_id", "left_anti").unionByName(own[name]).join(targets, "object_id", "left_semi") for name in ("units", "regions")]
        resolved = scratch.write(S.resolved_links(open_links, names, *places))

        # Of the links of other notes only those that came to another end are written.
        ends = ["occurrence_id", "status", "target_kind", "target_id"]
        same = scratch.write(_same(asked, resolved, ends))
        moved = scratch.write(resolved.join(same, "occurrence_id", "left_anti"))
        left = scratch.write(before.unionByName(asked.join(same, "occurrence_id", "left_anti")))
        gone = scratch.write(left.select("occurrence_id"))
        changes["occurrences"] = replaced("occurrences", "occurrence_id", moved, gone, store.of(_keys(store, "occurrences", left, moved)))
        incoming = _incoming(moved)
        changes["incoming"] = replaced("incoming", "occurrence_id", incoming, gone, store.of(_keys(store, "incoming", _incoming(left), incoming)))
        changes["names"] = replaced("names", "target_id", _names(new), gone_names, store.of(touched))
        mentions = _mentions(authored)
        changes["mentions"] = replaced("mentions", "source_object_id", mentions, ids.withColumnRenamed("object_id", "source_object_id"), store.of(_keys(store, "mentions", _mentions(before), mentions)))
        store.commit({name: change for name, change in changes.items() if change[1]})


def _changed(store: Buckets, written: DataFrame, removed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Return the notes that differ from the stored ones, and the ids of all that change."""
    content = F.xxhash64(*(F.map_entries(c) if c.startswith("front") else F.col(c) for c in _CONTENT)).alias("content")
    asked = scratch.write(written)
    going = scratch.write(removed.select("object_id").distinct())
    have = store.read("notes", store.of(asked.select("object_id").unionByName(going))).select("object_id", content)
    new = scratch.write(asked.join(asked.select("object_id", content).join(have, ["object_id", "content"], "left_semi"), "object_id", "left_anti"))
    ids = new.select("object_id").unionByName(going.join(have, "object_id", "left_semi")).distinct()
    return new, scratch.write(ids)


def _same(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Ids of rows that are equal in both tables, nulls included."""
    other = new.select(*(F.col(c).alias(f"_{c}") for c in columns))
    equal = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return old.join(other, equal).select(columns[0])


def _keys(store: Buckets, table: str, *parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.select(store.keys[table]) for x in parts)).distinct()
