"""Projection queries: units, segments, inheritance, links, anchors, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import projection as P
from quillstrata.sources import read_table

SEGMENT = 280
HREF = 'href="([^"]*)"'


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as units."""
    return P.split_units(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier assignments of documents, from their columns and labels."""
    documents, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    joined = documents.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    pairs = F.array(*(F.struct(F.lit(c).alias("identifier_name"), F.col(c).cast("string").alias("value")) for c in ("lang", "source", "quality", "toxic")))
    return joined.select(F.col("doc_id").alias("object_id"), F.col("lang").alias("class_name"), F.inline(pairs)).where("value is not null")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored links of pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    found = pages.select(F.col("page_id").alias("source_id"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("at", "target"))
    return found.select("source_id", (F.col("at") + 1).cast("long").alias("ordinal"), "target")


_UNITS = "SELECT doc_id AS object_id, i::BIGINT AS ordinal, string_split(text, chr(10))[i] AS content FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_ASSIGN = """SELECT object_id, class_name, identifier_name, value FROM (
  SELECT d.doc_id AS object_id, d.lang AS class_name, unnest(['lang', 'source', 'quality', 'toxic']) AS identifier_name,
         unnest([d.lang, d.source, l.quality::VARCHAR, l.toxic::VARCHAR]) AS value
  FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE value IS NOT NULL"""
_LINKS = """SELECT source_id, i::BIGINT AS ordinal, t[i] AS target FROM (
  SELECT page_id AS source_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS t FROM pages))"""


@register("unit_split", _UNITS)
def unit_split(spark, sf_dir):
    """Every line of every document."""
    return units(spark, sf_dir)


@register("unit_identity", f"SELECT concat_ws('#', object_id::VARCHAR, 'root', ordinal::VARCHAR) AS unit_id, sha256(concat_ws('#', object_id::VARCHAR, 'root', ordinal::VARCHAR)) AS digest FROM ({_UNITS})")
def unit_identity(spark, sf_dir):
    """Reversible identities of units."""
    identity = P.unit_id(F.col("object_id"), F.lit("root"), F.col("ordinal"))
    return units(spark, sf_dir).select(identity.alias("unit_id"), F.sha2(identity, 256).alias("digest"))


@register("normalized_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normalized FROM documents")
def normalized_text(spark, sf_dir):
    """Searchable form of documents."""
    return read_table(spark, sf_dir, "documents").select("doc_id", P.normalized(F.col("text")).alias("normalized"))


_SEGMENTS = f"""SELECT object_id, ordinal, k::BIGINT AS segment_ordinal, n::BIGINT AS total_segments, substring(content, (k * {SEGMENT} + 1)::INT, {SEGMENT}) AS span FROM (
  SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, greatest(ceil(length(content) / {SEGMENT}.0), 1)::BIGINT AS n FROM ({_UNITS})))"""


@register("segment_split", _SEGMENTS)
def segment_split(spark, sf_dir):
    """Transport segments of units."""
    return P.transport_segments(units(spark, sf_dir), SEGMENT)


@register("segment_rebuild", _UNITS)
def segment_rebuild(spark, sf_dir):
    """Units put together again from their segments."""
    return P.rebuild(P.transport_segments(units(spark, sf_dir), SEGMENT))


@register("inherit_identifiers", f"SELECT u.object_id, u.ordinal, a.identifier_name, a.value, 'object:' || u.object_id::VARCHAR AS provenance FROM ({_UNITS}) u JOIN ({_ASSIGN}) a ON u.object_id = a.object_id")
def inherit_identifiers(spark, sf_dir):
    """Assignments that units inherit."""
    found = P.inherit(units(spark, sf_dir), assignments(spark, sf_dir))
    return found.select("object_id", "ordinal", "identifier_name", "value", "provenance")


@register("assignment_applicability", f"SELECT object_id, class_name, identifier_name, value FROM ({_ASSIGN}) WHERE NOT (identifier_name IN ('lang', 'source') OR (class_name IN ('en', 'de') AND identifier_name = 'quality') OR (class_name = 'en' AND identifier_name = 'toxic'))")
def assignment_applicability(spark, sf_dir):
    """Assignments that their object's class does not allow."""
    allowed = [("en", ["lang", "source", "quality", "toxic"]), ("de", ["lang", "source", "quality"]), ("fr", ["lang", "source"]), ("es", ["lang", "source"])]
    classes = spark.createDataFrame(allowed, "class_name string, identifiers array<string>")
    return P.misapplied(assignments(spark, sf_dir), classes).select("object_id", "class_name", "identifier_name", "value")


@register("link_extract", _LINKS)
def link_extract(spark, sf_dir):
    """Links as authored."""
    return links(spark, sf_dir)


_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_RESOLVED = f"""SELECT l.*, CASE WHEN n = 1 THEN o END AS target_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
  FROM ({_LINKS}) l LEFT JOIN (SELECT {_PATH} AS name, count(DISTINCT page_id) AS n, min(page_id) AS o FROM pages GROUP BY 1) k ON l.target = k.name"""


def _resolved(spark, sf_dir):
    names = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("name"), F.col("page_id").alias("target_id"))
    return P.resolve(links(spark, sf_dir), names)


@register("link_resolution_status", _RESOLVED)
def link_resolution_status(spark, sf_dir):
    """Links with their target, or the reason why they have none."""
    return _resolved(spark, sf_dir)


@register("reverse_incidence", f"SELECT target, count(*) AS incoming, string_agg(source_id::VARCHAR || ':' || ordinal::VARCHAR, ',' ORDER BY source_id, ordinal) AS sources FROM ({_LINKS}) GROUP BY target")
def reverse_incidence(spark, sf_dir):
    """What reaches each target."""
    return P.reverse_incidence(links(spark, sf_dir), "target", "source_id", "ordinal")


@register("heading_regions", """SELECT page_id, i::BIGINT AS ordinal, h[i] AS heading FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h FROM pages))""")
def heading_regions(spark, sf_dir):
    """Headings of pages as regions."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1))).alias("at", "heading"))
    return found.select("page_id", (F.col("at") + 1).cast("long").alias("ordinal"), "heading")


@register("temporal_anchors", "SELECT 'anchor:order_date:' || o_orderkey::VARCHAR AS anchor_id, o_orderkey::VARCHAR AS object_id, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def temporal_anchors(spark, sf_dir):
    """Anchors of dated orders; priorities are identifiers without anchors."""
    orders = read_table(spark, sf_dir, "orders")
    pairs = F.array(F.struct(F.lit("order_date").alias("identifier_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")), F.struct(F.lit("priority").alias("identifier_name"), F.col("o_orderpriority").alias("value")))
    rows = orders.select(F.col("o_orderkey").cast("string").alias("object_id"), F.inline(pairs))
    descriptors = spark.createDataFrame([("order_date", "creates_anchor"), ("priority", "none")], "identifier_name string, temporal_affordance string")
    return P.temporal_anchors(rows, descriptors)


_KIND_TABLES = {"semantic_object": "part", "semantic_unit": "documents", "occurrence": "lineitem", "temporal_anchor": "orders"}


@register("surface_membership", "SELECT k.kind, s.surface_id, k.records FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS records FROM {table}" for kind, table in _KIND_TABLES.items()) + ") k JOIN (VALUES ('exact', true, ['semantic_object', 'semantic_unit']), ('lexical', true, ['semantic_unit']), ('vector', false, ['semantic_unit']), ('graph', true, ['semantic_object', 'occurrence']), ('temporal', true, ['temporal_anchor'])) s(surface_id, available, visible) ON available AND list_contains(visible, k.kind)")
def surface_membership(spark, sf_dir):
    """How many records of each kind every surface sees."""
    counts = [read_table(spark, sf_dir, table).agg(F.count("*").alias("records")).select(F.lit(kind).alias("kind"), "records") for kind, table in _KIND_TABLES.items()]
    held = reduce(DataFrame.unionByName, counts)
    surfaces = [("exact", True, ["semantic_object", "semantic_unit"]), ("lexical", True, ["semantic_unit"]), ("vector", False, ["semantic_unit"]), ("graph", True, ["semantic_object", "occurrence"]), ("temporal", True, ["temporal_anchor"])]
    members = P.surface_membership(held.select("kind"), spark.createDataFrame(surfaces, "surface_id string, available boolean, visible_kinds array<string>"))
    return members.join(held, "kind").select("kind", "surface_id", "records")


_ROW = "sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(30)), coalesce(lang, chr(30)), coalesce(source, chr(30)), coalesce(text, chr(30))))"


@register("logical_hash", "SELECT n AS row_count, sha256(concat_ws(':', h0::VARCHAR, h1::VARCHAR, h2::VARCHAR, h3::VARCHAR)) AS logical_hash FROM (SELECT count(*) AS n, " + ", ".join(f"coalesce(sum(('0x' || substring(r, {1 + 8 * k}, 8))::BIGINT), 0)::BIGINT AS h{k}" for k in range(4)) + f" FROM (SELECT {_ROW} AS r FROM documents))")
def logical_hash(spark, sf_dir):
    """One hash of all documents."""
    return P.logical_hash(read_table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "text"])


@register("snapshot_diff", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 = 0)")
def snapshot_diff(spark, sf_dir):
    """Changes between two made-up snapshots: records that only one of them has, or that differ."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    before = documents.where("doc_id % 7 <> 0")
    after = documents.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return P.snapshot_diff(before, after, "doc_id", ["text"])
