"""Retrieval surfaces: exact, lexical, vector, graph and temporal search.

The choices that were left open are made here: terms are runs of letters and
digits of the lower-cased text; vectors are ranked by dot product; ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Probes of one matrix product, and how far rounding may shift a score.
NEAR_BLOCK, SLACK = 256, 1e-9

_DECLARED: dict[str, Callable[..., DataFrame]] = {}


def declare_mode(name: str, search: Callable[..., DataFrame]) -> None:
    """Support a declared match mode."""
    _DECLARED[name] = search


def declared(name: str, *args: object) -> DataFrame:
    """Search by a declared mode; an unknown one is an error, never skipped."""
    if name not in _DECLARED:
        raise KeyError(f"match mode {name} is not supported")
    return _DECLARED[name](*args)


def scope(records: DataFrame, bound: DataFrame, key: str) -> DataFrame:
    """Restrict records to a bound set, before any search."""
    return records.join(bound.select(key).distinct(), key, "left_semi")


#: Probes, and bytes of them, that are sent to all tasks at once; more make more passes.
PROBES, PROBE_BYTES = 50_000, 32 << 20


def _blocks(probes: DataFrame, id_col: str, value: str) -> Iterator[list[Row]]:
    """Read a stated query set in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for row in probes.select(id_col, value).where(F.col(value).isNotNull()).toLocalIterator():
        weight = len(row[1]) * (1 if isinstance(row[1], str) else 8)
        if block and (len(block) == PROBES or size + weight > PROBE_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += weight
    if block:
        yield block


def _passes(records: DataFrame, schema: StructType, runs: Iterator[Callable]) -> DataFrame:
    """One pass over the records for each block of probes."""
    parts = [records.mapInArrow(run, schema) for run in runs]
    return reduce(DataFrame.unionByName, parts) if parts else records.sparkSession.createDataFrame([], schema)


def _pair_schema(records: DataFrame, record_id: str, probes: DataFrame, probe_id: str, *more: tuple[str, str]) -> StructType:
    schema = StructType([StructField(probe_id, probes.schema[probe_id].dataType), StructField(record_id, records.schema[record_id].dataType)])
    for name, kind in more:
        schema = schema.add(name, kind)
    return schema


def exact(records: DataFrame, probes: DataFrame, record_id: str, probe_id: str, text: str, literal: str) -> DataFrame:
    """Return (probe_id, record_id): all pairs of a probe and a record that contains its literal.

    Exhaustive: one Aho-Corasick pass finds all probes of a block in a record, and records
    are not shuffled. Null texts and literals match nothing, an empty literal all texts.
    """
    schema = _pair_schema(records, record_id, probes, probe_id)
    out = to_arrow_schema(schema)

    def matcher(block: list[Row]) -> Callable:
        rows = [tuple(r) for r in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            owners: dict[str, list[int]] = {}
            for k, (_, word) in enumerate(rows):
                owners.setdefault(word, []).append(k)
            always = owners.pop("", [])
            engine = ahocorasick.Automaton()
            for word, listed in owners.items():
                engine.add_word(word, listed)
            if len(engine):
                engine.make_automaton()
            for batch in batches:
                at, found = [], []
                for n, value in enumerate(batch.column(1).to_pylist()):
                    if value is None:
                        continue
                    hit = set(always)
                    for _, listed in engine.iter(value) if len(engine) else ():
                        hit.update(listed)
                    at += [n] * len(hit)
                    found += sorted(hit)
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in found], out.types[0]), batch.column(0).take(pa.array(at, pa.int64()))], schema=out)

        return run

    return _passes(records.select(record_id, text), schema, map(matcher, _blocks(probes, probe_id, literal)))


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def _spread(values: np.ndarray, begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return values[begin[k] : begin[k + 1]] for every key, and which key each came from."""
    many = begin[key + 1] - begin[key]
    at = np.repeat(np.arange(len(key)), many)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return values[begin[key][at] + inside], at


def best_terms(records: DataFrame, probes: DataFrame, record_id: str, probe_id: str, text: str, k: int) -> DataFrame:
    """Return (probe_id, record_id, matched, position): the ``k`` records with most of a probe's terms.

    ``probes`` has ``terms``. A batch of records is held against an inverted index of a block
    of probes, and only its own best ``k`` of each probe leave the task, so that frequent
    terms make no pairs beyond a batch. Ties go to the smaller record id.
    """
    schema = _pair_schema(records, record_id, probes, probe_id, ("matched", "long"))
    out = to_arrow_schema(schema)

    def matcher(block: list[Row]) -> Callable:
        rows = [tuple(r) for r in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places: dict[str, list[int]] = {}
            for n, (_, words) in enumerate(rows):
                for word in set(words):
                    places.setdefault(word, []).append(n)
            known = pa.array(list(places), pa.string())
            begin = np.append(0, np.cumsum([len(x) for x in places.values()]))
            listed = np.array([n for x in places.values() for n in x], np.int64)
            for batch in batches:
                lists = batch.column(1)
                words = lists.flatten()
                owner = lists.value_parent_indices().to_numpy()
                code = pc.index_in(words, known)
                has = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                probe, at = _spread(listed, begin, code.drop_null().to_numpy().astype(np.int64))
                doc = owner[has][at]
                pair, matched = np.unique(probe * np.int64(len(batch)) + doc, return_counts=True)
                probe, doc = pair // max(1, len(batch)), pair % max(1, len(batch))
                rank = np.empty(len(batch), np.int64)
                rank[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(len(batch))
                order = np.lexsort((rank[doc], -matched, probe))
                probe, doc, matched = probe[order], doc[order], matched[order]
                keep = np.arange(len(probe)) - np.searchsorted(probe, probe) < k
                yield pa.RecordBatch.from_arrays([pa.array([rows[n][0] for n in probe[keep].tolist()], out.types[0]), batch.column(0).take(pa.array(doc[keep])), pa.array(matched[keep].astype(np.int64))], schema=out)

        return run

    listed = records.where(F.col(text).isNotNull()).select(record_id, terms(F.col(text)).alias("terms"))
    return top(_passes(listed, schema, map(matcher, _blocks(probes, probe_id, "terms"))), probe_id, [F.desc("matched"), record_id], k, "position")


def nearest(records: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Return (probe_id, record_id, position) of the ``k`` nearest other vectors by dot product.

    ``records`` has (record_id, vector), ``probes`` (probe_id, probe). A batch of records is one
    matrix product with a block of probes; its own best ``k`` of each probe leave the task.
    Scores are summed again in order for these, so that equal vectors tie. It creates no
    relation between records.
    """
    schema = _pair_schema(records, "record_id", probes, "probe_id", ("score", "double"))
    out = to_arrow_schema(schema)

    def matcher(block: list[Row]) -> Callable:
        ids, matrix = [r[0] for r in block], np.array([r[1] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = {x: n for n, x in enumerate(ids)}
            for batch in batches:
                whole = batch.filter(batch.column(1).is_valid())
                if not len(whole):
                    continue
                vectors = np.stack(whole.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                rank = np.empty(len(whole), np.int64)
                rank[pc.sort_indices(whole.column(0)).to_numpy()] = np.arange(len(whole))
                own = np.array([place.get(x, -1) for x in whole.column(0).to_pylist()])
                for first in range(0, len(ids), NEAR_BLOCK):
                    part = matrix[first : first + NEAR_BLOCK]
                    scores = vectors @ part.T
                    mine = np.flatnonzero((own >= first) & (own < first + len(part)))
                    scores[mine, own[mine] - first] = -np.inf
                    least = np.partition(scores, max(0, len(whole) - k), axis=0)[max(0, len(whole) - k)]
                    row, col = np.nonzero((scores >= least - SLACK * np.maximum(1, np.abs(least))) & np.isfinite(scores))
                    exact_score = np.cumsum(vectors[row] * part[col], axis=1)[:, -1] if len(row) else np.zeros(0)
                    order = np.lexsort((rank[row], -exact_score, col))
                    row, col, exact_score = row[order], col[order], exact_score[order]
                    keep = np.arange(len(col)) - np.searchsorted(col, col) < k
                    yield pa.RecordBatch.from_arrays([pa.array([ids[first + n] for n in col[keep].tolist()], out.types[0]), whole.column(0).take(pa.array(row[keep])), pa.array(exact_score[keep])], schema=out)

        return run

    scored = _passes(records.select("record_id", "vector"), schema, map(matcher, _blocks(probes, "probe_id", "probe")))
    return top(scored, "probe_id", [F.desc("score"), "record_id"], k, "position").select("probe_id", "record_id", "position")


def top(rows: DataFrame, group: str, order: list, k: int, position: str) -> DataFrame:
    """The first ``k`` rows of each group; ranks are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(position, rank).where(F.col(position) <= k).withColumn(position, F.col(position).cast("long"))


def in_range(value: Column, start: Column, end: Column) -> Column:
    """Inclusive range with optional ends."""
    return (start.isNull() | (value >= start)) & (end.isNull() | (value <= end))


def incidence(edges: DataFrame, bound: DataFrame, transition: str, direction: str) -> DataFrame:
    """Edges of one transition and direction that leave bound records."""
    typed = edges.where((F.col("transition_id") == transition) & (F.col("direction") == direction))
    return typed.join(bound, "source_id", "left_semi")
