"""Notes, links, segments, strict records and live threads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillstrata.functions import records
from quillstrata.operators import projection as P
from quillstrata.operators import fold, structure, surfaces, validation
from quillstrata.sources import notes, shared
from quillstrata.streaming import threads
from quillstrata.streaming.threads import answer_contributions, use_rocksdb

NOTE = """---
uuid: {ABCDEF01-2345-6789-ABCD-EF0123456789}
type: book
---
Lead paragraph
goes on.

# One
- a
- b

## Two
```
code

more
```

> quoted ^b1
"""


@pytest.fixture(scope="module")
def blocks(spark):
    files = spark.createDataFrame([("p/n.md", "n.md", NOTE), ("p/m.md", "m.md", "no front matter")], "path string, filename string, text string")
    return notes.admit(notes.parse_notes(files))


def test_note_admission_and_blocks(blocks):
    by = {r.filename: r for r in blocks.collect()}
    assert by["n.md"].object_id == "abcdef01-2345-6789-abcd-ef0123456789"
    assert by["n.md"].admission == "admitted"
    assert by["m.md"].admission == "unresolved"
    rows = P.markdown_blocks(blocks.where("admission = 'admitted'")).orderBy("ordinal").collect()
    assert [(r.block_type, list(r.heading_path)) for r in rows] == [("paragraph", []), ("list", ["One"]), ("code_block", ["One", "Two"]), ("block_quote", ["One", "Two"])]
    assert rows[0].content == "Lead paragraph\ngoes on."
    assert rows[2].content == "```\ncode\n\nmore\n```"
    assert rows[3].block_id == "b1"


def test_wikilinks(spark):
    df = spark.createDataFrame([(1, "See [[Moby Dick|the whale]], ![[Chart#Axis]] and [[Log#^b2]].")], "id int, text string")
    found = [tuple(r)[2:] for r in P.wikilinks(df, "id", "text").orderBy("ordinal").collect()]
    assert found == [(False, "Moby Dick", None, None, "the whale"), (True, "Chart", "Axis", None, None), (False, "Log", None, "b2", None)]


def test_segments_rebuild_any_order(spark):
    units = spark.createDataFrame([(1, 1, "añb😀cdefg"), (1, 2, ""), (2, 1, "xyz")], "object_id int, ordinal long, content string")
    cut = P.transport_segments(units, 3)
    assert cut.count() == 5
    assert sorted(map(tuple, P.rebuild(cut.repartition(4)).collect())) == sorted(map(tuple, units.collect()))


def test_logical_hash_ignores_order_but_not_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    one = P.logical_hash(a, ["id", "v"]).first()
    assert P.logical_hash(a.orderBy(F.desc("id")), ["id", "v"]).first() == one
    assert P.logical_hash(a.union(a.limit(1)), ["id", "v"]).first() != one


def test_hydration_checks_hashes(spark):
    wanted = spark.sql("SELECT 'a' AS address, sha2('text', 256) AS content_hash UNION ALL SELECT 'b', 'wrong'")
    content = spark.sql("SELECT 'a' AS address, 'text' AS content UNION ALL SELECT 'b', 'other'")
    assert {r.address: r.verified for r in notes.hydrate(wanted, content).collect()} == {"a": True, "b": False}


def test_integrity_checks_find_planted_faults(spark):
    occurrences = spark.sql("SELECT 'o1' AS occurrence_id, 'u' AS source_id, 'x' AS target_id, 'semantic_unit' AS source_kind, 'semantic_object' AS target_kind")
    listed = spark.sql("SELECT 'u' AS record_id, 'o1' AS occurrence_id")
    assert [r.side for r in validation.incidence_faults(occurrences, listed).collect()] == ["target"]
    transitions = spark.sql("SELECT 'semantic_unit' AS from_kind, 'outgoing' AS direction, 'occurrence' AS to_kind")
    assert validation.missing_transitions(occurrences, transitions).count() == 3
    bad = spark.sql("SELECT 'exact' AS kind, 'bounded' AS coverage, true AS total_count, true AS available")
    assert validation.coverage_faults(bad).count() == 1


def test_undeclared_mode_fails():
    with pytest.raises(KeyError):
        surfaces.declared("sonar")


def test_strict_records():
    turn = {"conv_id": 1, "turn": 0, "role": "user", "text": None}
    assert records.decode(json.dumps(turn), records.RECORDS["chat-turn"]) == turn
    for wrong in (turn | {"x": 1}, {"conv_id": 1}, turn | {"role": "robot"}, turn | {"conv_id": 2**64}, turn | {"turn": -1}, turn | {"turn": True}):
        with pytest.raises(ValueError, match=r"\$"):
            records.decode(json.dumps(wrong), records.RECORDS["chat-turn"])


def test_live_threads(spark, tmp_path):
    def said(n, turn=None):
        lists = ("region_operations", "relation_operations", "constraint_operations", "tension_operations", "attention_operations", "preservation_declarations", "release_declarations")
        return json.dumps({"contribution_id": f"c{n}", "source_turn_id": turn or f"t{n}", "source_utterance_id": f"u{n}"} | {x: [] for x in lists})

    schema = "thread_id string, sequence long, contribution string"
    rows = [[("x", 1, said(1)), ("y", 1, said(1))], [("x", 2, said(2)), ("y", 3, said(3)), ("x", 3, said(3, "t1"))]]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    session = spark.newSession()
    use_rocksdb(session)
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = answer_contributions(stream).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.thread_id, r.sequence): (r.accepted, r.version, r.code) for r in session.table("answers").collect()}
    assert got == {("x", 1): (True, 1, None), ("y", 1): (True, 1, None), ("x", 2): (True, 2, None), ("x", 3): (False, 2, "duplicate_accepted_identity"), ("y", 3): (False, 1, "accepted_entry_sequence_mismatch")}


def test_a_live_thread_writes_what_changes(spark, tmp_path):
    """A contribution to a large thread writes the records it names, not the thread."""
    from pathlib import Path

    def said(n, regions):
        lists = {x: [] for x in fold.LISTS} | {"region_operations": regions}
        return "x", n, json.dumps({"contribution_id": f"c{n}", "source_turn_id": f"t{n}", "source_utterance_id": f"u{n}"} | lists)

    def region(identity):
        return {"region_id": identity, "anchor_referents": [], "relation_ids": [], "local_constraint_ids": [], "open_tension_ids": [], "source_contribution_ids": [], "persistence_state": "active", "activation_band": "primary", "supersedes_region_id": None}

    session = spark.newSession()
    threads.use_rocksdb(session)
    session.conf.set("spark.sql.shuffle.partitions", "1")
    schema, folder = "thread_id string, sequence long, contribution string", str(tmp_path / "live")
    first = [said(n, [{"operation": "create", "region": region(f"r{n}.{k}")} for k in range(20)]) for n in range(1, 61)]
    for batch in (first, [said(61, [{"operation": "reinforce", "region_id": "r7.3", "reason": ""}])]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/inbox")
        threads.run_available(session.readStream.schema(schema).parquet(f"{folder}/inbox"), folder)
    written = {int(p.name.split(".")[0].split("_")[0]): p.stat().st_size for p in Path(folder).rglob("*.changelog")}
    versions = sorted(written)
    assert len(versions) >= 2 and written[versions[-1]] * 20 < written[versions[0]], written
    answers = spark.read.parquet(f"{folder}/answers")
    assert answers.where("accepted").count() == 61
    assert answers.where("sequence = 61").first().changes == [("region", "r7.3", "active")]


def test_a_live_thread_asks_for_a_record_once():
    """Contributions that arrive together read and write a record once; those that begin a thread read none."""
    from collections import Counter

    calls = Counter()

    class State(dict):
        def getValue(self, key):
            calls["read", id(self), key] += 1
            return self.get(key)

        def containsKey(self, key):
            calls["read", id(self), key] += 1
            return key in self

        def updateValue(self, key, value):
            calls["write", id(self), key] += 1
            self[key] = value

    class Head:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            calls["write", "head"] += 1
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return Head()

        def getMapState(self, name, key, value):
            return State()

    def said(n, regions):
        lists = {x: [] for x in fold.LISTS} | {"region_operations": regions}
        return {"sequence": n, "contribution": json.dumps({"contribution_id": f"c{n}", "source_turn_id": f"t{n}", "source_utterance_id": f"u{n}"} | lists)}

    region = {"region_id": "r", "anchor_referents": [], "relation_ids": [], "local_constraint_ids": [], "open_tension_ids": [], "source_contribution_ids": [], "persistence_state": "active", "activation_band": "primary", "supersedes_region_id": None}
    again = [{"operation": "reinforce", "region_id": "r", "reason": ""}]
    live = threads.Threads(fold.UNLIMITED)
    live.init(Handle())

    def answered(*rows):
        calls.clear()
        return [(x.sequence, x.accepted, x.version, x.code) for x in live.handleInputRows(("x",), iter(rows), None)]

    assert answered(said(2, again), said(1, [{"operation": "create", "region": region}]), said(3, again)) == [(1, True, 1, None), (2, True, 2, None), (3, True, 3, None)]
    assert max(calls.values()) == 1 and not [x for x in calls if x[0] == "read"]
    assert answered(said(4, again), said(5, again), said(5, again)) == [(4, True, 4, None), (5, True, 5, None), (5, False, 5, "accepted_entry_sequence_mismatch")]
    assert max(calls.values()) == 1 and [x for x in calls if x[0] == "read"]
    assert answered(said(2, again)) == [(2, False, 5, "accepted_entry_sequence_mismatch")] and not calls


def test_shared_snapshots_follow_their_files(spark, tmp_path):
    built = []

    def value():
        return shared(spark, str(tmp_path), ("t",), "numbers", lambda: built.append(1) or len(built))

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert value() == value() == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert value() == 2


def test_headings_among_fences_and_skipped_levels(spark):
    """A heading path has the last heading of each level that no higher one has ended; code holds no headings."""
    body = "intro\n### Deep\n# One\n## Two\n### Three\n~~~\n# code\n~~~\n# Next\n### Far\ntext\n## Near\n# \nlast"
    note = spark.createDataFrame([("a", body), ("b", "")], "object_id string, body string")
    regions = P.markdown_regions(note).where("object_id = 'a'").orderBy("ordinal").collect()
    assert [(r.address, r.level) for r in regions] == [("root", 0), ("Deep", 3), ("One", 1), ("One > Two", 2), ("One > Two > Three", 3), ("Next", 1), ("Next > Far", 3), ("Next > Near", 2), ("", 1)]
    units = P.markdown_blocks(note).orderBy("ordinal").collect()
    assert [(" > ".join(u.heading_path), u.content) for u in units] == [("", "intro"), ("One > Two > Three", "~~~\n# code\n~~~"), ("Next > Far", "text"), ("", "last")]


def test_bodies_are_read_in_lines_twice(spark):
    """A snapshot's tables are kept before others are made of them; regions are made of the lines that mark them."""
    fields = "object_id string, title string, class_name string, front_matter map<string,string>, front_lists map<string,array<string>>, body string"
    rows = [("a", "A", "n", {"class": "n"}, {"to": ["[[B]]"]}, "# One\ntext [[B#Two]]"), ("b", "B", "n", {"class": "n"}, {}, "## Two\ntext ^k")]
    described = spark.createDataFrame([("class", "none")], "identifier_name string, temporal_affordance string")
    exploded = []

    def keep(table):
        exploded.append(table._jdf.queryExecution().optimizedPlan().toString().count("split(body"))
        return spark.createDataFrame(table.collect(), table.schema)

    made = structure.build(spark.createDataFrame(rows, fields), described, keep)
    assert sum(exploded) == 2 and made.occurrences.where("status = 'resolved'").count() == 2
