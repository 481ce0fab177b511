"""Persisted indexes of texts: postings of terms or of character triples.

An index has tables in buckets: ``dictionary`` (unit, records that have it), ``postings``
(unit, block, ids), where a block is a bounded list, ``records`` (id, text, units), and
``richest``, the records with most units. A search reads the dictionary's buckets of its own units, the postings of
the rarest of these, and the records that are still possible; what it reads follows from
what it asks for, not from the size of the corpus. Both searches are exact.

A literal of at least three characters stands only in records that have all its triples:
the records that have the rarest ones are opened and compared, so that a search stays
complete and may claim that there is no match.

A ranked search wants the records with most of a probe's terms. The richest records, and
some that have its rarest terms, are scored at first, which gives a score that the last of
the best has at least. A record with that
score has one of all but so many of the probe's terms, so that the most frequent terms,
whose postings are the longest, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillstrata.operators.surfaces import exact, terms, top
from quillstrata.sources import Scratch
from quillstrata.sources.buckets import Buckets

KEYS = {"dictionary": "unit", "postings": "unit", "records": "record_id", "richest": "record_id"}
#: Ids of one block of postings, about.
BLOCK = 1024
#: Ids of one list that a task makes of a batch, at most.
LIST = BLOCK // 4
#: Triples of a literal, the rarest ones, that records must have to be opened.
ASKED = 16
#: Terms of a probe that the first scores come from, and records that every probe is scored against.
LEAD, RICHEST = 3, 256
#: Rows of probes and units that are sent to every task (about 60 bytes each); more are shuffled.
BROADCAST_ROWS = 300_000


def triples(text: Column) -> Column:
    """Distinct runs of three characters of a text, overlapping ones included."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _lists(stored: DataFrame) -> DataFrame:
    """Return (unit, ids): the records of each Arrow batch that have a unit, in lists of ``LIST`` at most.

    A row for each record and unit would be many times as many, to be sorted and grouped.
    """
    identity = stored.schema["record_id"].dataType
    schema = StructType([StructField("unit", StringType()), StructField("ids", ArrayType(identity))])
    fields = to_arrow_schema(schema)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("units")
            codes = pc.list_flatten(units).dictionary_encode()
            at = np.asarray(codes.indices)
            order = np.argsort(at, kind="stable")
            at, holders = at[order], np.asarray(pc.list_parent_indices(units))[order]
            # A list begins with a unit, and after every ``LIST`` records of it.
            first = np.flatnonzero(np.diff(at, prepend=-1))
            place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            starts = np.flatnonzero(place % LIST == 0)
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), batch.column("record_id").take(pa.array(holders)))
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(at[starts])).cast(fields.field(0).type), ids.cast(fields.field(1).type)], schema=fields)

    return stored.select("record_id", "units").mapInArrow(group, schema)


def build(store: Buckets, records: DataFrame, record_id: str, text: str, units: Callable[[Column], Column]) -> None:
    """Write the index of (record_id, text); null texts have no units, and ids are distinct."""
    rows = records.where(F.col(text).isNotNull()).select(F.col(record_id).alias("record_id"), F.col(text).alias("text"), units(F.col(text)).alias("units"))
    with Scratch(records.sparkSession) as scratch:
        stored = scratch.write(rows)
        lists = scratch.write(_lists(stored))
        dictionary = scratch.write(lists.groupBy("unit").agg(F.sum(F.size("ids")).alias("records")))
        # Lists of a frequent unit are dealt over as many blocks as they need.
        many = dictionary.where(F.col("records") > BLOCK).select("unit", F.ceil(F.col("records") / BLOCK).alias("blocks"))
        block = F.pmod(F.xxhash64(F.col("ids")[0]), F.coalesce("blocks", F.lit(1)))
        listed = lists.join(many, "unit", "left").groupBy("unit", block.alias("block")).agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
        richest = stored.select("record_id", "units").orderBy(F.desc(F.size("units")), "record_id").limit(RICHEST)
        store.commit({"dictionary": (dictionary, None), "postings": (listed, None), "records": (stored, None), "richest": (richest, None)})


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _asked(store: Buckets, probes: DataFrame, scratch: Scratch) -> DataFrame:
    """Return (probe_id, unit, records, place, known) of probes (probe_id, unit): units by rarity, and how many of them records have.

    Places are counted from 1 among the units that records have; the others have 0 records and place 0.
    """
    wanted = scratch.write(probes.select("unit").distinct())
    found = scratch.write(store.read("dictionary", store.of(wanted)).join(_sent(wanted), "unit", "left_semi"))
    each = Window.partitionBy("probe_id")
    joined = probes.join(found, "unit", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    counted = joined.withColumn("known", F.sum((F.col("records") > 0).cast("int")).over(each)).withColumn("row", F.row_number().over(each.orderBy("records", "unit")))
    unknown = F.count("*").over(each) - F.col("known")
    return scratch.write(counted.withColumn("place", F.greatest(F.col("row") - unknown, F.lit(0))).drop("row"))


def _pairs(store: Buckets, asked: DataFrame) -> DataFrame:
    """Return (probe_id, record_id, n): how many of the asked units a record has."""
    buckets = store.of(asked.select("unit"))
    held = store.read("postings", buckets).join(_sent(asked.select("probe_id", "unit")), "unit")
    return held.select("probe_id", F.explode("ids").alias("record_id")).groupBy("probe_id", "record_id").agg(F.count("*").alias("n"))


def _opened(store: Buckets, pairs: DataFrame) -> DataFrame:
    """Records of (probe_id, record_id, ...), from their buckets alone."""
    return store.read("records", store.of(pairs.select("record_id"))).join(pairs, "record_id")


def literal(store: Buckets, probes: DataFrame, probe_id: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Return ((probe_id, record_id) of records that hold a probe's text, (probe_id, opened) how many were compared).

    Null texts match nothing. Texts of less than three characters have no triples: all
    records are compared with them.
    """
    asked = probes.where(F.col(text).isNotNull()).select(F.col(probe_id).alias("probe_id"), F.col(text).alias("literal"))
    long, short = asked.where(F.char_length("literal") >= 3), asked.where(F.char_length("literal") < 3)
    units = scratch.write(long.select("probe_id", F.explode(triples(F.col("literal"))).alias("unit")))
    rare = scratch.write(_asked(store, units, scratch).where(F.col("place") <= ASKED))
    needed = rare.groupBy("probe_id").agg(F.count("*").alias("needed"))
    possible = scratch.write(_pairs(store, rare.where("records > 0")).join(_sent(needed), "probe_id").where("n = needed").select("probe_id", "record_id"))
    found = _opened(store, possible).join(_sent(long), "probe_id").where(F.col("text").contains(F.col("literal"))).select("probe_id", "record_id")
    if not short.isEmpty():
        found = found.unionByName(exact(store.read("records").select("record_id", "text"), short, "record_id", "probe_id", "text", "literal"))
    return found.withColumnRenamed("probe_id", probe_id), possible.groupBy(F.col("probe_id").alias(probe_id)).agg(F.count("*").alias("opened"))


def ranked(store: Buckets, probes: DataFrame, probe_id: str, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Return ((probe_id, record_id, matched, position), (probe_id, asked, read)): the ``k`` records with most terms of ``probes`` (probe_id, terms).

    Ties go to the smaller id. ``asked`` are the postings of all of a probe's terms, ``read``
    those that were read.
    """
    whole = scratch.write(probes.select(F.col(probe_id).alias("probe_id"), F.array_distinct("terms").alias("terms")))
    asked = _asked(store, whole.select("probe_id", F.explode("terms").alias("unit")), scratch).where("records > 0")

    matched = F.size(F.array_intersect("units", "terms")).cast("long").alias("matched")

    def scored(pairs: DataFrame) -> DataFrame:
        return _opened(store, pairs).join(_sent(whole), "probe_id").select("probe_id", "record_id", matched)

    first = top(_pairs(store, asked.where(F.col("place") <= LEAD)), "probe_id", [F.desc("n"), "record_id"], k, "position")
    # The richest records are few, so that probes meet all of them.
    richest = whole.crossJoin(F.broadcast(store.read("richest"))).select("probe_id", "record_id", matched)
    scores = scored(first.select("probe_id", "record_id")).unionByName(richest).where("matched > 0").distinct()
    some = scratch.write(top(scores, "probe_id", [F.desc("matched"), "record_id"], k, "position"))
    # The score that the last of the best has at least; 1 if fewer were scored.
    least = some.groupBy("probe_id").agg(F.when(F.count("*") >= k, F.min("matched")).otherwise(1).alias("least"))
    # A record with ``least`` terms has more than ``spare`` of all but the ``least - 1 - spare`` most frequent ones.
    spare = F.floor((F.col("least") - 1) / 2)
    limits = asked.select("probe_id", "known").distinct().join(least, "probe_id", "left").withColumn("least", F.coalesce("least", F.lit(1))).withColumn("spare", spare)
    bounded = scratch.write(limits.withColumn("reach", F.col("known") - F.col("least") + 1 + F.col("spare")))
    rare = scratch.write(asked.drop("known").join(_sent(bounded), "probe_id").where(F.col("place") <= F.col("reach")))
    possible = scratch.write(_pairs(store, rare).join(_sent(bounded), "probe_id").where("n > spare").select("probe_id", "record_id"))
    best = top(scored(possible), "probe_id", [F.desc("matched"), "record_id"], k, "position")
    cost = asked.groupBy("probe_id").agg(F.sum("records").alias("asked")).join(rare.groupBy("probe_id").agg(F.sum("records").alias("read")), "probe_id", "left")
    return best.withColumnRenamed("probe_id", probe_id), cost.withColumnRenamed("probe_id", probe_id)


def term_index(store: Buckets, records: DataFrame, record_id: str, text: str) -> None:
    """Write the index for ``ranked``."""
    build(store, records, record_id, text, terms)


def literal_index(store: Buckets, records: DataFrame, record_id: str, text: str) -> None:
    """Write the index for ``literal``."""
    build(store, records, record_id, text, triples)
