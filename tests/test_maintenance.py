"""A maintained projection against one that is built anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import maintenance as M
from quillstrata.operators import structure as S
from quillstrata.queries import maintenance as Q
from quillstrata.queries import vault as W
from quillstrata.sources.buckets import Buckets

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def notes(spark):
    return W.notes(spark, DATA).cache()


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def built(notes, described):
    own = S.own_tables(notes, described)
    occurrences = S.resolved_links(S.authored_links(notes, own["units"]), M._names(notes), own["units"], own["regions"])
    return {"notes": notes, **own, "occurrences": occurrences, "incoming": M._incoming(occurrences), "names": M._names(notes), "mentions": M._mentions(occurrences)}


def test_merged_tables_equal_a_rebuild(spark, notes, tmp_path):
    described = W.descriptors(spark)
    store = Buckets(spark, str(tmp_path), M.KEYS, 4)
    M.start(store, notes, described)
    written, removed = Q.changes(spark, DATA, notes)
    M.apply(store, written, removed, described)
    after = notes.join(written, "object_id", "left_anti").unionByName(written).join(removed, "object_id", "left_anti")
    for name, expected in built(after, described).items():
        assert rows(store.read(name)) == rows(expected), name
    # Once more, with nothing new.
    M.apply(store, written, removed, described)
    assert store.version == 1


def test_only_what_a_change_touches_is_written(spark, notes, tmp_path):
    described = W.descriptors(spark)
    store = Buckets(spark, str(tmp_path), M.KEYS, 32)
    M.start(store, notes, described)
    one = notes.where("title = 'Customer 000000020'").withColumn("body", F.replace("body", F.lit("two ^list"), F.lit("two ^item")))
    M.apply(store, one, notes.select("object_id").limit(0), described)
    touched = {name: [b for b, version in held.items() if version == 1] for name, held in store.manifest.items()}
    assert all(len(touched[name]) == 1 for name in M.OWN), touched
    # The note itself, and the one note whose link asked for the block.
    assert len(touched["occurrences"]) <= 2 and len(touched["names"]) == 1
    assert rows(store.read("occurrences")) == rows(built(notes.join(one, "object_id", "left_anti").unionByName(one), described)["occurrences"])
    lost = store.read("occurrences").where("block_id = 'list20'").first()
    assert (lost.status, lost.target_id) == ("unresolved", None)


def test_a_name_that_two_notes_have_is_ambiguous_until_one_goes(spark, notes, tmp_path):
    described = W.descriptors(spark)
    store = Buckets(spark, str(tmp_path), M.KEYS, 2)
    title = notes.where("class_name = 'nation'").first().title
    few = notes.where((F.col("title") == title) | F.col("body").contains(f"[[{title}")).limit(8)
    few = spark.createDataFrame(few.collect(), notes.schema)
    M.start(store, few, described)
    nobody = few.select("object_id").limit(0)
    twin = few.where(F.col("title") == title).withColumn("object_id", F.lit("00000000-0000-0000-0000-00000000000a"))
    before = rows(store.read("occurrences"))
    M.apply(store, twin, nobody, described)
    assert {r.status for r in store.read("occurrences").where(F.col("target") == title).collect()} == {"ambiguous"}
    M.apply(store, few.limit(0), twin.select("object_id"), described)
    assert rows(store.read("occurrences")) == before and store.version == 2
