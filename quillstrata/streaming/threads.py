"""Live threads: contributions folded as they arrive, with keyed state.

A thread's state is kept as typed maps: its regions, relations, constraints and tensions,
what hangs on regions, and the identities it has seen. A contribution reads and writes
the records it names, whatever the size of its thread; no log is kept or folded again.
Contributions of a thread that arrive together read a record once and write it once, and
one that begins a thread reads none. A
contribution that the fold accepts changes the state; one that breaks a rule, or arrives
out of sequence, is answered with its violation and changes nothing. There is no event
time in the log, so there is no watermark: order within a thread is given by sequence
numbers, and late or repeated entries are rejected, never dropped in silence.

Map state needs the RocksDB state store, which ``use_rocksdb`` selects for a session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillstrata.operators import fold

CHANGE = "struct<family:string, id:string, lifecycle:string>"
ANSWERS = f"thread_id string, sequence long, accepted boolean, version long, code string, changes array<{CHANGE}>"

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Map states: (key, value).
_MAPS = {
    "regions": ("id string", "place long, persistence_state string, activation_band string, supersedes_region_id string, sources long, referents long"),
    "referents": ("region_id string, n long", "referent_id string, expression string, source_contribution_id string"),
    "sources": ("region_id string, n long", "contribution_id string"),
    "owners": ("referent_id string", "region_ids string"),
    "relations": ("id string", "place long, relation_id string, source_region_id string, relation_type string, target_region_id string, source_contribution_id string, lifecycle string"),
    "constraints": ("id string", "place long, constraint_id string, expression string, applicability string, source_contribution_id string, lifecycle string"),
    "tensions": ("id string", "place long, tension_id string, region_id string, tension_type string, unresolved_expression string, candidate_bindings string, source_turn_id string, lifecycle string"),
    "degrees": ("family string, region_id string", "n long"),
    "seen": ("kind string, identity string", "accepted boolean"),
}
#: Fields that are kept as JSON, and tables whose value is one field.
_NESTED = {"relation_type", "applicability", "tension_type", "candidate_bindings", "region_ids"}
_SINGLE = {"sources", "owners", "degrees", "seen"}
_HEAD = "version long, places long, operational_regions long, active_relations long, open_tensions long, background_regions long, first_turn string, last_turn string"


def use_rocksdb(spark: SparkSession) -> None:
    """Let the streams of a session keep their state in RocksDB, and write what changes to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class _Table:
    """A map state as a table of the fold: the records of one thread by key.

    Each record is asked for once until ``clear``, and reaches the state by ``flush``.
    """

    def __init__(self, name: str, state: MapState) -> None:
        self._state, self._fields, self._single = state, _fields(_MAPS[name][1]), name in _SINGLE
        self._nested = [f in _NESTED for f in self._fields]
        self.clear(False)

    def clear(self, empty: bool) -> None:
        """Forget the records of the thread before; an ``empty`` state need not be asked."""
        self._known, self._new, self._empty = {}, {}, empty

    @staticmethod
    def _key(key: object) -> tuple:
        return key if isinstance(key, tuple) else (key,)

    def get(self, key: object) -> object:
        if key not in self._known:
            held = None if self._empty else self._state.getValue(self._key(key))
            if held is not None:
                held = [json.loads(x) if nested and x is not None else x for nested, x in zip(self._nested, held, strict=True)]
                held = held[0] if self._single else dict(zip(self._fields, held, strict=True))
            self._known[key] = held
        return self._known[key]

    def __setitem__(self, key: object, value: object) -> None:
        self._known[key] = self._new[key] = value

    def flush(self) -> None:
        """Write the records that have changed."""
        for key, value in self._new.items():
            row = [value] if self._single else [value.get(f) for f in self._fields]
            self._state.updateValue(self._key(key), tuple(json.dumps(x, ensure_ascii=False) if nested and x is not None else x for nested, x in zip(self._nested, row, strict=True)))
        self._new = {}


class Threads(StatefulProcessor):
    """Answers each contribution of a thread and keeps the thread's state."""

    def __init__(self, limits: fold.Limits) -> None:
        self._limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", _HEAD)
        self._tables = {name: _Table(name, handle.getMapState(name, key, value)) for name, (key, value) in _MAPS.items()}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        thread, held = key[0], self._head.get()
        for table in self._tables.values():
            # A thread has a head from its first accepted contribution on, and nothing before.
            table.clear(held is None)
        space = fold.Space(thread, self._tables, dict(zip(_fields(_HEAD), held, strict=True)) if held is not None else None)
        before, answers = space.head["version"], []
        for row in sorted(rows, key=lambda r: r["sequence"]):
            code, changes = None, []
            version = space.head["version"]
            try:
                if row["sequence"] != version + 1:
                    raise fold.Violation("accepted_entry_sequence_mismatch", index=version)
                contribution = json.loads(row["contribution"])
                changes = space.accept(contribution, self._limits).changes
                version += 1
            except fold.Violation as broken:
                code = broken.record["code"]
            answers.append(Row(thread_id=thread, sequence=row["sequence"], accepted=code is None, version=version, code=code, changes=[Row(family=f, id=i, lifecycle=x) for f, i, x in changes]))
        for table in self._tables.values():
            table.flush()
        if space.head["version"] != before:
            self._head.update(tuple(space.head[f] for f in _fields(_HEAD)))
        yield from answers

    def close(self) -> None:
        """Nothing is held outside the state."""


def run_available(stream: DataFrame, folder: str, limits: fold.Limits = fold.UNLIMITED) -> None:
    """Answer all that has arrived, then end; answers go to ``folder``/answers.

    Called again with the same folder it goes on from the checkpoint in it: every
    contribution is answered once, also if a run was lost on the way.
    """
    answers = answer_contributions(stream, limits).writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/checkpoint")
    answers.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def lifecycles(answers: DataFrame) -> DataFrame:
    """Return (thread_id, family, id, lifecycle): what every record has become, from a table of answers."""
    told = answers.where("accepted").select("thread_id", "sequence", F.inline("changes"))
    return told.groupBy("thread_id", "family", "id").agg(F.max_by("lifecycle", "sequence").alias("lifecycle"))


def answer_contributions(stream: DataFrame, limits: fold.Limits = fold.UNLIMITED) -> DataFrame:
    """Return one answer for each arriving (thread_id, sequence, contribution).

    An accepted contribution tells the lifecycle of every region, relation, constraint and
    tension that it declared, changed or ended; the last one of each is the thread's state.
    """
    keyed = stream.select("thread_id", "sequence", "contribution").groupBy("thread_id")
    return keyed.transformWithState(Threads(limits), ANSWERS, "append", "None")
