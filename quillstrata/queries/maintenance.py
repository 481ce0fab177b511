"""A maintained projection of the vault: some notes change, one goes, some come.

Every fiftieth customer's note gets another block id, one nation's note another heading,
one nation's note goes, and notes come that links already ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import maintenance as M
from quillstrata.queries import vault as W
from quillstrata.sources import durable_table, read_table, shared, work_folder
from quillstrata.sources.buckets import Buckets

#: Buckets of each table.
BUCKETS = 16


def changes(spark: SparkSession, sf_dir: str, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return the notes that are written again or new, and the ids of those that go."""
    key = F.regexp_extract("title", r"(\d+)$", 1).cast("int")
    people = notes.where((F.col("class_name") == "customer") & (key % 50 == 7)).withColumn("body", F.replace("body", F.lit("two ^list"), F.lit("two ^item")))
    nation = read_table(spark, sf_dir, "nation")
    place = notes.join(nation.where("n_nationkey = 3").select(F.col("n_name").alias("title")), "title", "left_semi").select(*notes.columns).withColumn("body", F.replace("body", F.lit("# Facts"), F.lit("# Data")))
    asked = read_table(spark, sf_dir, "customer").where("c_custkey % 50 = 10").select(W._uuid(F.concat(F.lit("missing:"), F.col("c_custkey").cast("string"))).alias("object_id"), F.concat(F.lit("Missing "), "c_custkey").alias("title"))
    fields = F.create_map(F.lit("class"), F.lit("extra")).alias("front_matter")
    none = F.from_json(F.lit("{}"), "map<string, array<string>>").alias("front_lists")
    found = asked.select("object_id", "title", F.lit("extra").alias("class_name"), fields, none, F.lit("Found.").alias("body"))
    removed = nation.where("n_nationkey = 4").select(W._uuid(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))).alias("object_id"))
    # One note is written again as it was.
    same = notes.where((F.col("class_name") == "customer") & (key == 1))
    return people.unionByName(place).unionByName(found).unionByName(same), removed


def maintained(spark: SparkSession, sf_dir: str) -> Buckets:
    """The projection after the changes, made once an application."""

    def build() -> Buckets:
        notes = durable_table(W.notes(spark, sf_dir))
        store = Buckets(spark, work_folder(spark), M.KEYS, BUCKETS)
        M.start(store, notes, W.descriptors(spark))
        M.apply(store, *changes(spark, sf_dir, notes), W.descriptors(spark))
        return store

    return shared(spark, sf_dir, ("customer", "nation", "region"), "maintained", build)


_HOME = "(SELECT n_name FROM nation WHERE n_nationkey = {0})"
_MISSING = W._id("'missing:' || c.k::VARCHAR")
_AFTER = f"""{W._CTE}, y AS (SELECT x.*, c.k, x.embed AND c.k % 50 = 10 AS made, {_MISSING} AS made_id,
    (x.block_id IS NULL AND NOT x.embed AND c.home = {_HOME.format(4)}) OR (x.heading IS NOT NULL AND c.home = {_HOME.format(3)}) OR (x.block_id IS NOT NULL AND (c.k - 1) % 50 = 7) AS gone FROM x JOIN c ON c.id = x.source_object_id),
  z AS (SELECT occurrence_id, source_object_id, CASE WHEN made THEN 'resolved' WHEN gone THEN 'unresolved' ELSE status END AS status,
    CASE WHEN made THEN 'semantic_object' WHEN NOT gone THEN target_kind END AS target_kind, CASE WHEN made THEN made_id WHEN NOT gone THEN target_id END AS target_id FROM y)"""


@register("maintained_occurrences", f"{_AFTER} SELECT occurrence_id, status, target_kind, target_id FROM z")
def maintained_occurrences(spark, sf_dir):
    """Ends of all links, those of unchanged notes included."""
    return maintained(spark, sf_dir).read("occurrences").select("occurrence_id", "status", "target_kind", "target_id")


@register("maintained_units", f"""{_AFTER} SELECT u.object_id || '#' || CASE WHEN n.title = {_HOME.format(3)} THEN 'Data' ELSE address END || '#' || ordinal::VARCHAR AS unit_id,
  CASE WHEN c.k % 50 = 7 THEN replace(content, 'two ^list', 'two ^item') ELSE content END AS content, CASE WHEN c.k % 50 = 7 THEN replace(block_id, 'list', 'item') ELSE block_id END AS block_id
  FROM u LEFT JOIN c ON c.id = u.object_id LEFT JOIN n ON n.id = u.object_id WHERE n.title IS NULL OR n.title <> {_HOME.format(4)}
  UNION ALL SELECT {_MISSING} || '#root#1', 'Found.', '' FROM c WHERE c.k % 50 = 10""")
def maintained_units(spark, sf_dir):
    """Units of all notes."""
    return maintained(spark, sf_dir).read("units").select("unit_id", "content", "block_id")


@register("maintained_incoming", f"{_AFTER} SELECT target_id, target_kind, count(*) AS links, min(occurrence_id) AS first_link FROM z WHERE status = 'resolved' GROUP BY target_id, target_kind")
def maintained_incoming(spark, sf_dir):
    """How many links reach each record, and the first of them."""
    return maintained(spark, sf_dir).read("incoming").groupBy("target_id", "target_kind").agg(F.count("*").alias("links"), F.min("occurrence_id").alias("first_link"))
