"""Raw facts of files and their admission."""

from __future__ import annotations

from quillstrata.operators import observation as O

UUID = "00000000-0000-0000-0000-00000000000{}"
WHOLE = """---
uuid: {0}
tags:
  - a
empty:
---
# One

See [[two#Part|alias]], [[both]], [[gone]] and [[two#^b]].

![[two]] %% note %%
"""
FILES = [
    ("v/one.md", "one.md", WHOLE.format(UUID.format(1))),
    ("v/two.md", "two.md", "---\nuuid: nothing\n---\n# Part\n\nText ^b"),
    ("v/a/both.md", "both.md", f"---\nuuid: {UUID.format(2)}\n---\nx"),
    ("v/b/both.md", "both.md", f"---\nuuid: {UUID.format(2)}\n---\ny"),
    ("v/open.md", "open.md", "---\nuuid: x\nno end"),
    ("v/null.md", "null.md", None),
    ("v/empty.md", "empty.md", ""),
]


def observed(spark, rows):
    return O.admit(O.observe(spark.createDataFrame(rows, "path string, filename string, text string"), "s1"))


def test_twenty_kinds_and_five_classes(spark):
    facts = observed(spark, FILES)
    rows = facts.collect()
    assert {r.fact_kind for r in rows} == set(O.KINDS) and len(O.KINDS) == 20
    assert {r["class"] for r in rows} == set(O.CLASSES)
    found = {(r.path, r.fact_kind, r.about): (r["class"], r.rule) for r in rows}
    assert len(found) == len(rows)
    assert found["v/one.md", "wikilink", "2"] == ("quarantined", "target_ambiguous")
    assert found["v/one.md", "unresolved_target", "3"] == ("unresolved", "target_missing")
    assert found["v/one.md", "frontmatter_shape", "empty"] == ("open_authoring_decision", "field_without_value")
    assert found["v/one.md", "frontmatter_shape", "tags"][0] == "admitted"
    assert found["v/one.md", "unsupported_syntax", "1"][0] == "open_authoring_decision"
    assert found["v/two.md", "source_identity", "1"] == ("rejected", "identity_malformed")
    assert found["v/two.md", "heading", "1"] == ("quarantined", "file_without_identity")
    assert found["v/a/both.md", "source_identity", "1"] == ("quarantined", "identity_shared")
    assert found["v/open.md", "parse_failure", "1"] == ("rejected", "front_matter_open")
    assert {k for p, k, _ in found if p == "v/null.md"} == {"source_path", "source_identity", "corpus_snapshot"}
    assert all(r.authority and (r.lost == "") == (r["class"] == "admitted") for r in rows)
    assert observed(spark, []).count() == 0


def test_later_evidence_releases_what_waits(spark):
    later = [x for x in FILES if x[0] != "v/b/both.md"]
    got = {(r.path, r.fact_kind, r.about): r.outcome for r in O.release(observed(spark, FILES), observed(spark, later)).collect()}
    assert got["v/one.md", "wikilink", "2"] == "admitted" and got["v/one.md", "ambiguous_target", "2"] == "gone"
    assert got["v/a/both.md", "source_identity", "1"] == "admitted" and got["v/b/both.md", "source_identity", "1"] == "gone"
    assert got["v/two.md", "heading", "1"] == "quarantined"


def test_bodies_and_links_are_read_once(spark):
    """Facts of several kinds are made of kept tables, not of the files anew for each kind."""
    rows = [("a.md", "a.md", "---\nuuid: x\nclass: n\n---\n# One\n[[b#Two|t]] ![[c]]\n<b>"), ("b.md", "b.md", "plain [[a]]"), ("c.md", "c.md", None)]
    files = spark.createDataFrame(rows, "path string, filename string, text string")
    kept = []

    def keep(table):
        kept.append(table._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame(table.collect(), table.schema)

    observed = O.observe(files, "s", keep)
    plan = observed._jdf.queryExecution().optimizedPlan().toString()
    assert sum("[[" in x or "\\[" in x for x in kept) >= 1 and plan.count("posexplode(split(text") == 1 and plan.count("(!?)") == 0
    columns = ("path", "fact_kind", "about", "ordinal")
    assert sorted(map(repr, observed.select(*columns, observed.fact.cast("string")).collect())) == sorted(map(repr, (x := O.observe(files, "s")).select(*columns, x.fact.cast("string")).collect()))
