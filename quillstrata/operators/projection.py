"""Building a projection: objects, regions, units, links, anchors and hashes.

All builders are set-based. Order is carried in ordinal columns, never in the
order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that open another kind of block than a paragraph, tried in this order.
_BLOCKS = (("code_block", r"^(```|~~~)"), ("equation", r"^\$\$"), ("callout", r"^> \[!"), ("block_quote", r"^>"), ("table", r"^\|"), ("list", r"^\s*([-*+]|\d+[.)])\s"), ("embedded_media", r"^!\[\["))
#: Lines that open or close fenced code, or may be headings.
_MARKS = r"^(```|~~~|#{1,6}\s)"
_LINK = r"(!?)\[\[([^\]|#]*)(#[^\]|]*)?(\|[^\]]*)?\]\]"


def split_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (object_id, ordinal, content): one unit a line, ordinals from 1."""
    lines = df.select(F.col(id_col).alias("object_id"), F.posexplode(F.split(text_col, "\n")).alias("at", "content"))
    return lines.select("object_id", (F.col("at") + 1).cast("long").alias("ordinal"), "content")


def unit_id(object_id: Column, region: Column, ordinal: Column) -> Column:
    """Reversible identity of a unit: object, region address and ordinal."""
    return F.concat_ws("#", object_id.cast("string"), region, ordinal.cast("string"))


def normalized(text: Column) -> Column:
    """Searchable form of authored text: lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Address of the region before the first heading; every object has it.
ROOT = "root"


def region_address(heading_path: Column) -> Column:
    """Address of a region within its object: its headings from the top."""
    return F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > ")).otherwise(ROOT)


def _lines(notes: DataFrame, only: str = "") -> DataFrame:
    """Lines of Markdown bodies with level (0 if it is no heading), heading path, and whether code holds them.

    ``only`` is a pattern of the lines that are wanted; it must take in fences and headings,
    which decide about the others.
    """
    lines = notes.select("object_id", F.posexplode(F.split("body", "\n")).alias("line", "content")).where(F.col("content").rlike(only))
    order = Window.partitionBy("object_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("fence", F.col("content").rlike(r"^(```|~~~)").cast("int"))
    lines = lines.withColumn("inside", (F.sum("fence").over(order) % 2 == 1) | (F.col("fence") == 1))
    lines = lines.withColumn("level", F.when(~F.col("inside"), F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1))).otherwise(0))
    lines = lines.withColumn("title", F.when(F.col("level") > 0, F.regexp_replace("content", r"^#{1,6}\s+", "")))
    # A level's heading holds until a heading of the same or a higher level.
    last = {n: F.max(F.when(F.col("level") == n, F.struct("line", "title"))).over(order).alias(f"last{n}") for n in range(1, 7)}
    lines = lines.select("*", *last.values())
    titles = []
    for n in range(1, 7):
        above = F.greatest(F.lit(-1), F.lit(-1), *(F.col(f"last{k}.line") for k in range(1, n)))
        titles.append(F.when(F.col(f"last{n}.line") > above, F.col(f"last{n}.title")))
    return lines.withColumn("heading_path", F.array_compact(F.array(*titles))).drop("fence", *(f"last{n}" for n in last))


def markdown_regions(notes: DataFrame) -> DataFrame:
    """Return (object_id, address, ordinal, level, title, parent_address) of Markdown bodies.

    Every heading path is one region, with prose or without; every object has the
    region ``ROOT``, with ordinal and level 0, also if its body is empty.
    """
    headings = _lines(notes, _MARKS).where("level > 0").groupBy("object_id", "heading_path").agg(F.min(F.struct("line", "level", "title")).alias("first"))
    ordinal = F.row_number().over(Window.partitionBy("object_id").orderBy("first.line")).cast("long")
    parent = F.slice("heading_path", 1, F.size("heading_path") - 1)
    named = headings.select("object_id", region_address(F.col("heading_path")).alias("address"), ordinal.alias("ordinal"), F.col("first.level").cast("long").alias("level"), F.col("first.title").alias("title"), region_address(parent).alias("parent_address"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    return notes.select("object_id", F.lit(ROOT).alias("address"), zero.alias("ordinal"), zero.alias("level"), none.alias("title"), none.alias("parent_address")).unionByName(named)


def markdown_blocks(notes: DataFrame) -> DataFrame:
    """Return (object_id, ordinal, heading_path, block_type, content, block_id) of Markdown bodies.

    Blocks are separated by blank lines; fenced code stays whole. Headings open
    regions: a block's path is the nearest heading of each level above it.
    """
    lines = _lines(notes)
    order = Window.partitionBy("object_id").orderBy("line")
    breaks = ((~F.col("inside") & (F.trim("content") == "")) | (F.col("level") > 0)).cast("int")
    lines = lines.withColumn("block", F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("level = 0 and (inside or trim(content) <> '')")
    rows = F.array_sort(F.collect_list(F.struct("line", "content")))
    blocks = lines.groupBy("object_id", "heading_path", "block").agg(rows.alias("rows"))
    content = F.array_join(F.transform("rows", lambda x: x["content"]), "\n")
    kind = F.lit("paragraph")
    for name, pattern in reversed(_BLOCKS):
        kind = F.when(F.col("content").rlike(pattern), name).otherwise(kind)
    blocks = blocks.select("object_id", "heading_path", F.col("rows")[0]["line"].alias("line"), content.alias("content"))
    ordinal = F.row_number().over(Window.partitionBy("object_id").orderBy("line")).cast("long")
    return blocks.select("object_id", ordinal.alias("ordinal"), "heading_path", kind.alias("block_type"), "content", F.regexp_extract("content", r"\^([A-Za-z0-9-]+)\s*$", 1).alias("block_id"))


def wikilinks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (source_id, ordinal, embed, target, heading, block_id, alias) of authored links."""
    found = df.select(F.col(id_col).alias("source_id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(_LINK), F.lit(0))).alias("at", "authored"))

    def part(n: int) -> Column:
        return F.regexp_extract("authored", _LINK, n)

    anchor = F.regexp_replace(part(3), "^#", "")
    return found.select(
        "source_id",
        (F.col("at") + 1).cast("long").alias("ordinal"),
        (part(1) == "!").alias("embed"),
        F.trim(part(2)).alias("target"),
        F.when((anchor != "") & ~anchor.startswith("^"), anchor).alias("heading"),
        F.when(anchor.startswith("^"), F.substring(anchor, 2, 1 << 20)).alias("block_id"),
        F.when(part(4) != "", F.regexp_replace(part(4), r"^\|", "")).alias("alias"),
    )


def transport_segments(units: DataFrame, size: int) -> DataFrame:
    """Cut content longer than ``size`` characters into ordered segments."""
    total = F.greatest(F.ceil(F.char_length("content") / F.lit(float(size))), F.lit(1)).cast("long")
    cut = units.withColumn("total_segments", total).select("*", F.explode(F.expr("sequence(0L, total_segments - 1)")).alias("segment_ordinal"))
    return cut.select("object_id", "ordinal", "segment_ordinal", "total_segments", F.expr(f"substring(content, cast(segment_ordinal * {size} + 1 as int), {size})").alias("span"))


def rebuild(segments: DataFrame) -> DataFrame:
    """Return (object_id, ordinal, content) from segments in any order."""
    parts = F.array_sort(F.collect_list(F.struct("segment_ordinal", "span")))
    return segments.groupBy("object_id", "ordinal").agg(F.array_join(F.transform(parts, lambda x: x["span"]), "").alias("content"))


def inherit(units: DataFrame, assignments: DataFrame) -> DataFrame:
    """Give every unit the assignments of its object; provenance stays at the object."""
    return units.join(assignments, "object_id").withColumn("provenance", F.concat(F.lit("object:"), F.col("object_id").cast("string")))


def resolve(links: DataFrame, names: DataFrame) -> DataFrame:
    """Add target_id and status to links by a dictionary (name, target_id).

    A name with several targets is ambiguous, one with none unresolved; neither
    gets a target.
    """
    known = names.groupBy("name").agg(F.count_distinct("target_id").alias("targets"), F.min("target_id").alias("only"))
    joined = links.join(known, links["target"] == known["name"], "left").drop("name")
    status = F.when(F.col("targets") == 1, "resolved").when(F.col("targets") > 1, "ambiguous").otherwise("unresolved")
    return joined.select(*links.columns, F.when(F.col("targets") == 1, F.col("only")).alias("target_id"), status.alias("status"))


def reverse_incidence(links: DataFrame, target: str, source: str, ordinal: str) -> DataFrame:
    """Return (target, incoming, sources): the links that reach each target, in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), F.col(ordinal).alias("ordinal"))))
    text = F.transform(listed, lambda x: F.concat_ws(":", x["source"].cast("string"), x["ordinal"].cast("string")))
    return links.groupBy(target).agg(F.count("*").alias("incoming"), F.array_join(text, ",").alias("sources"))


def temporal_anchors(assignments: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Assignments of identifiers that create anchors, as anchors on their subject."""
    making = descriptors.where("temporal_affordance = 'creates_anchor'").select("identifier_name")
    rows = assignments.join(making, "identifier_name")
    return rows.select(F.concat_ws(":", F.lit("anchor"), "identifier_name", "object_id").alias("anchor_id"), "object_id", "value")


def block_targets(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return (map of block ids to one unit, block ids that name several units)."""
    named = blocks.where("block_id <> ''").groupBy("object_id", "block_id").agg(F.count("*").alias("units"), F.min("ordinal").alias("ordinal"))
    return named.where("units = 1").drop("units"), named.where("units > 1")


def surface_membership(kinds: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Every capable surface of every record kind."""
    seen = surfaces.where("available").select("surface_id", F.explode("visible_kinds").alias("kind"))
    return kinds.join(seen, "kind").select("kind", "surface_id")


def logical_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash of the rows that does not depend on their order.

    Row hashes are added up in four parts, so that no task sees all rows; equal
    inputs give equal hashes and a repeated row counts.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns)), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long")), F.lit(0)).alias(f"h{k}") for k in range(4)]
    return df.agg(F.count("*").alias("row_count"), *sums).select("row_count", F.sha2(F.concat_ws(":", *(F.col(f"h{k}").cast("string") for k in range(4))), 256).alias("logical_hash"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Return (key, change) of records that were added, removed or changed."""
    row = F.xxhash64(*columns)
    both = before.select(key, row.alias("old")).join(after.select(key, row.alias("new")), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where("old is null or new is null or old <> new").select(key, change.alias("change"))


def misapplied(assignments: DataFrame, classes: DataFrame) -> DataFrame:
    """Assignments of identifiers that the object's class does not allow."""
    allowed = classes.select("class_name", F.explode("identifiers").alias("identifier_name"))
    return assignments.join(allowed, ["class_name", "identifier_name"], "left_anti")
