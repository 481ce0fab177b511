"""Observation of authored files before any of them means something, and admission of what was seen.

A file gives raw facts of twenty kinds, each a variant with its place in the file. They
name no objects, units or links yet. Admission puts every fact in one of five classes by a
rule, and keeps the fact, the rule, its authority, and what is lost. A fact in quarantine
waits for evidence: ``release`` holds two observations against each other and tells which
facts the later one lets go, and where to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions.identity import object_id
from quillstrata.operators import projection as P

# Kinds of raw facts, and classes of admission.
KINDS = (
    "source_path",
    "source_identity",
    "frontmatter_key",
    "frontmatter_shape",
    "frontmatter_provenance",
    "heading",
    "block_candidate",
    "raw_markdown",
    "wikilink",
    "alias",
    "embed",
    "heading_target",
    "block_target",
    "source_span",
    "parse_failure",
    "unsupported_syntax",
    "ambiguous_target",
    "unresolved_target",
    "source_hash",
    "corpus_snapshot",
)
CLASSES = ("admitted", "quarantined", "rejected", "unresolved", "open_authoring_decision")

#: Syntax that authors use and that no rule gives a meaning yet.
UNSUPPORTED = r"<[A-Za-z][^>\n]*>|%%[^%\n]*%%"
_KEY = r"^([A-Za-z_][\w-]*):[ \t]*(.*)$"

#: Rules by name: (authority, what is lost).
RULES = {
    "identity_valid_and_alone": ("identity", ""),
    "identity_shared": ("identity", "which file the identity means"),
    "identity_malformed": ("identity", "the written identity"),
    "identity_missing": ("identity", "an identity"),
    "file_without_identity": ("identity", "what the fact belongs to"),
    "front_matter_open": ("syntax", "the fields of the front matter"),
    "syntax_without_meaning": ("author", "the syntax"),
    "field_without_value": ("author", "a value"),
    "target_ambiguous": ("names", "which target is meant"),
    "target_missing": ("names", "a target"),
    "as_authored": ("file", ""),
}


def _facts(rows: DataFrame, kind: str, ordinal: Column, **fact: Column) -> DataFrame:
    """Facts of one kind; fields of the front matter are told apart by their keys, others by their place."""
    about = fact["key"] if kind.startswith("frontmatter") else ordinal.cast("string")
    return rows.select("path", F.lit(kind).alias("fact_kind"), about.alias("about"), ordinal.cast("long").alias("ordinal"), F.to_variant_object(F.struct(*(value.alias(name) for name, value in fact.items()))).alias("fact"))


def _kept(table: DataFrame) -> DataFrame:
    return table


def observe(files: DataFrame, snapshot: str, keep: Callable[[DataFrame], DataFrame] = _kept) -> DataFrame:
    """Return (path, fact_kind, about, ordinal, fact) of files (path, filename, text); null texts have a path alone.

    Ordinals count the facts of a kind in a file, from 1; ``about`` tells them apart in
    other states of the file, too. Links are resolved by file names
    without their ending. ``keep`` may write a table and return its reader: fields, bodies,
    blocks and links are each kept before facts of several kinds are made of them.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    each = Window.partitionBy("path")
    fence = (F.trim("content") == "---").cast("int")
    opened = F.max(F.when((F.col("line") == 0) & (fence == 1), 1)).over(each)
    closes = F.min(F.when((F.col("line") > 0) & (fence == 1), F.col("line"))).over(each)
    marked = lines.withColumns({"opened": F.coalesce(opened, F.lit(0)), "closes": closes})
    whole = (F.col("opened") == 1) & F.col("closes").isNotNull()
    front = marked.where(whole & (F.col("line") > 0) & (F.col("line") < F.col("closes")))
    later = F.lead("content").over(each.orderBy("line"))
    listed = front.withColumn("next", later).where(F.col("content").rlike(_KEY)).withColumns({"key": F.regexp_extract("content", _KEY, 1), "value": F.trim(F.regexp_extract("content", _KEY, 2))})
    nth = F.row_number().over(each.orderBy("line"))
    keys = keep(listed.select("path", "line", "key", "value", "next").withColumn("n", nth))
    shape = F.when(F.col("value").rlike(r"^\[(?!\[).*\]$") | ((F.col("value") == "") & F.col("next").rlike(r"^\s+- ")), "list").when(F.col("value") == "", "empty").otherwise("scalar")
    body = marked.where(~whole | (F.col("line") > F.col("closes")))
    bodies = keep(body.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("body")))
    notes = bodies.select(F.col("path").alias("object_id"), "body")
    heads = P.markdown_regions(notes).where("level > 0").withColumnRenamed("object_id", "path")
    blocks = keep(P.markdown_blocks(notes).withColumnRenamed("object_id", "path"))
    links = P.wikilinks(bodies, "path", "body").withColumnRenamed("source_id", "path")
    named = keep(P.resolve(links, files.select(F.regexp_replace("filename", r"\.md$", "").alias("name"), F.col("path").alias("target_id"))))
    odd = bodies.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(UNSUPPORTED), F.lit(0))).alias("at", "syntax"))
    identity = keys.where("key = 'uuid' and value <> ''").groupBy("path").agg(F.min("value").alias("written"))
    ids = files.select("path").join(identity, "path", "left").withColumn("parsed", object_id(F.col("written")))
    one, link, at = F.lit(1), F.col("ordinal"), F.col("n")
    parts = [
        _facts(files, "source_path", one, path=F.col("path"), filename=F.col("filename")),
        _facts(ids, "source_identity", one, written=F.col("written"), object_id=F.col("parsed")),
        _facts(keys, "frontmatter_key", at, key=F.col("key")),
        _facts(keys, "frontmatter_shape", at, key=F.col("key"), shape=shape),
        _facts(keys, "frontmatter_provenance", at, key=F.col("key"), line=F.col("line")),
        _facts(heads, "heading", F.col("ordinal"), level=F.col("level"), title=F.col("title"), parent=F.col("parent_address")),
        _facts(blocks, "block_candidate", F.col("ordinal"), type=F.col("block_type"), block_id=F.col("block_id")),
        _facts(bodies, "raw_markdown", one, markdown=F.col("body")),
        _facts(named, "wikilink", link, target=F.col("target"), status=F.col("status"), target_path=F.col("target_id")),
        _facts(named.where("alias is not null"), "alias", link, alias=F.col("alias")),
        _facts(named.where("embed"), "embed", link, target=F.col("target")),
        _facts(named.where("heading is not null"), "heading_target", link, target=F.col("target"), heading=F.col("heading")),
        _facts(named.where("block_id is not null"), "block_target", link, target=F.col("target"), block_id=F.col("block_id")),
        _facts(blocks, "source_span", F.col("ordinal"), characters=F.char_length("content"), bytes=F.octet_length("content")),
        _facts(marked.where((F.col("opened") == 1) & F.col("closes").isNull() & (F.col("line") == 0)), "parse_failure", one, expected=F.lit("an end of the front matter")),
        _facts(odd, "unsupported_syntax", F.col("at") + 1, syntax=F.col("syntax")),
        _facts(named.where("status = 'ambiguous'"), "ambiguous_target", link, target=F.col("target")),
        _facts(named.where("status = 'unresolved'"), "unresolved_target", link, target=F.col("target")),
        _facts(files.where("text is not null"), "source_hash", one, sha256=F.sha2("text", 256)),
        _facts(files, "corpus_snapshot", one, snapshot=F.lit(snapshot)),
    ]
    return reduce(DataFrame.unionByName, parts)


def admit(observed: DataFrame) -> DataFrame:
    """Add class, rule, authority and lost to every fact.

    A file whose identity is not admitted keeps its facts in quarantine, but for those that
    are faults themselves.
    """

    def field(name: str) -> Column:
        return F.variant_get("fact", f"$.{name}", "string")

    kind = F.col("fact_kind")
    own = observed.where(kind == "source_identity").select("path", field("written").alias("written"), field("object_id").alias("parsed"))
    shared = own.where("parsed is not null").groupBy("parsed").agg(F.count("*").alias("files"))
    judged = own.join(shared, "parsed", "left").select(
        "path", F.when(F.col("written").isNull(), "identity_missing").when(F.col("parsed").isNull(), "identity_malformed").when(F.col("files") > 1, "identity_shared").otherwise("identity_valid_and_alone").alias("identity")
    )
    faults = kind.isin("parse_failure", "unsupported_syntax", "source_path", "source_hash", "corpus_snapshot")
    rule = (
        F.when(kind == "source_identity", F.col("identity"))
        .when(kind == "parse_failure", "front_matter_open")
        .when(kind == "unsupported_syntax", "syntax_without_meaning")
        .when(~faults & (F.col("identity") != "identity_valid_and_alone"), "file_without_identity")
        .when((kind == "frontmatter_shape") & (F.col("said") == "empty"), "field_without_value")
        .when((kind == "ambiguous_target") | ((kind == "wikilink") & (F.col("said") == "ambiguous")), "target_ambiguous")
        .when((kind == "unresolved_target") | ((kind == "wikilink") & (F.col("said") == "unresolved")), "target_missing")
        .otherwise("as_authored")
    )
    classes = {"identity_shared": "quarantined", "identity_malformed": "rejected", "identity_missing": "unresolved", "file_without_identity": "quarantined", "front_matter_open": "rejected", "syntax_without_meaning": "open_authoring_decision", "field_without_value": "open_authoring_decision", "target_ambiguous": "quarantined", "target_missing": "unresolved"}

    def by_rule(values: dict[str, str], otherwise: str) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("rule")], F.lit(otherwise))

    # What the rules ask of a fact is read before the join, so that the fact itself need not go with it.
    said = F.when(kind == "frontmatter_shape", field("shape")).when(kind == "wikilink", field("status"))
    ruled = observed.withColumn("said", said).join(judged, "path", "left").withColumn("rule", rule).drop("identity", "said")
    return ruled.withColumns({"class": by_rule(classes, "admitted"), "authority": by_rule({k: a for k, (a, _) in RULES.items()}, ""), "lost": by_rule({k: x for k, (_, x) in RULES.items()}, "")})


def release(before: DataFrame, after: DataFrame) -> DataFrame:
    """Return (path, fact_kind, about, rule, outcome) of facts that an earlier observation had in quarantine.

    ``outcome`` is the class that the same fact has in the later observation, or ``gone``.
    """
    key = ["path", "fact_kind", "about"]
    held = before.where(F.col("class") == "quarantined").select(*key, "rule")
    return held.join(after.select(*key, F.col("class").alias("outcome")), key, "left").select(*key, "rule", F.coalesce("outcome", F.lit("gone")).alias("outcome"))
