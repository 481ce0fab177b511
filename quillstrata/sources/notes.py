"""Authored notes: Markdown files with front matter, and their admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions.identity import object_id

_FRONT = r"(?s)^---\n(.*?)\n---\n?"
_INDENTED = r"(?m)^[A-Za-z_][\w-]*:[ \t]*\n(?:[ \t]+- .*\n)+"
_ITEM = r"(?m)^[ \t]+- (.*)$"
_BRACKETS = r"^\[(?!\[)(.*)\]$"
#: Admission classes of an observation.
ADMISSION = ("admitted", "quarantined", "rejected", "unresolved", "open_authoring_decision")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Return (path, filename, front_matter, body), one row a file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    return parse_notes(files)


def parse_notes(files: DataFrame) -> DataFrame:
    """Split (path, filename, text) in front matter and body.

    Plain fields are in the map ``front_matter``; fields with a list, as indented
    items or in brackets, are in the map ``front_lists``.
    """
    block = F.regexp_extract("text", _FRONT, 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    fields = F.map_from_entries(F.array_distinct(entries))
    indented = F.transform(F.regexp_extract_all(F.concat(block, F.lit("\n")), F.lit(_INDENTED), F.lit(0)), lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.transform(F.regexp_extract_all(x, F.lit(_ITEM), F.lit(1)), F.trim).alias("values")))
    inline = F.transform(F.filter(entries, lambda e: e["value"].rlike(_BRACKETS)), lambda e: F.struct(e["key"].alias("key"), F.transform(F.split(F.regexp_extract(e["value"], _BRACKETS, 1), ","), F.trim).alias("values")))
    lists = F.map_from_entries(F.array_distinct(F.concat(indented, inline)))
    return files.select("path", "filename", fields.alias("front_matter"), lists.alias("front_lists"), F.regexp_replace("text", _FRONT, "").alias("body"))


def admit(notes: DataFrame) -> DataFrame:
    """Add object_id and admission: a note without a valid id is no object."""
    parsed = object_id(F.col("front_matter")["uuid"])
    status = F.when(parsed.isNotNull(), "admitted").when(F.col("front_matter")["uuid"].isNotNull(), "rejected").otherwise("unresolved")
    return notes.withColumn("object_id", parsed).withColumn("admission", status)


def hydrate(addresses: DataFrame, content: DataFrame) -> DataFrame:
    """Fetch content by address and check its hash: (address, content, verified)."""
    joined = addresses.join(content, "address", "left")
    return joined.withColumn("verified", F.coalesce(F.sha2("content", 256) == F.col("content_hash"), F.lit(False)))
