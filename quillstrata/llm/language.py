"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (lengths 1 to 4, A-Z
lower-cased) that both contain, over the root of the product of their numbers:
the normalised blended-spectrum presence kernel, on the n-grams of a vocabulary.
Kernel ridge regression, one language against the rest, is solved on Nystroem
landmarks. Since the kernel with all landmarks is a product of presence rows and
a landmark matrix, landmarks and weights multiply out beforehand to one matrix of
n-gram by language, and a batch of texts is scored by one product.

Training takes about ``PER_LANGUAGE`` labelled rows of each language, ``MOST_ROWS`` at
most, a documented bound; texts stay on the executors. Defined results: a null text, or one without a letter, is ``und`` with
score 0; a table without labelled rows makes every text ``und``; repeated rows and
repeated or null ids are predicted each; ids of a type other than integers raise
``TypeError``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import doc_blocks, integer_id, lower_table, map_batches, utf8
from quillstrata.llm.samples import stratified
from quillstrata.sources import Scratch

#: Rows that training uses of each language, landmarks among them, and languages.
PER_LANGUAGE, LANDMARKS, LANGUAGES = 600, 64, 20_000
#: Rows and landmarks of all languages together; many languages share them.
MOST_ROWS, MOST_LANDMARKS = 24_000, 1024
#: Hash space of n-grams and size of the vocabulary (the n-grams in most training texts).
SPACE_BITS, VOCABULARY = 18, 8192
RIDGE = 1e-3
ORDERS = 4
UNKNOWN = "und"
#: Bytes of text and documents made into presence rows at once.
BATCH, ROWS = 2 << 20, 512


@dataclass
class Model:
    """Column of each hashed n-gram (the last one is nowhere), weights and languages."""

    columns: np.ndarray
    weights: np.ndarray
    languages: list[str]


def _presence(data: np.ndarray, offsets: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
    """Return one row of n-gram presence for each text."""
    n = len(offsets) - 1
    rows = np.zeros((n, width + 1), np.uint8)
    if len(data):
        flat = rows.reshape(-1)
        doc = np.repeat(np.arange(n, dtype=np.int64) * (width + 1), np.diff(offsets))
        text = lower_table()[data].astype(np.uint32)
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        code = np.zeros(len(data), np.uint32)
        for order in range(1, ORDERS + 1):
            code = code[: len(data) - order + 1] << np.uint32(8) | text[order - 1 :]
            if not len(code):
                break
            key = (code * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - SPACE_BITS)
            inside = left[: len(code)] >= order
            flat[doc[: len(code)][inside] + columns[key[inside]]] = 1
    return rows[:, :width]


def _unpack(packed: list[bytes], width: int) -> np.ndarray:
    """Return normalised presence rows from packed bits."""
    bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    rows = np.unpackbits(bits, axis=1, count=width).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def _vocabulary(sample: DataFrame) -> np.ndarray:
    """Return the hashed n-grams that occur in most texts of the sample, in order."""
    space = 1 << SPACE_BITS
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, identity = np.zeros(space, np.int64), np.arange(space, dtype=np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i in range(0, len(batch), 64):
                j = min(len(batch), i + 64)
                found += _presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], identity, space).sum(axis=0, dtype=np.int64)
        keys = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found[keys])], schema=schema)

    counts = map_batches(sample.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(VOCABULARY).collect()
    return np.sort(np.array([r.key for r in top], np.int64))


def _rows(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Return (lang, bits): the language and the packed presence row of every text of the sample."""
    schema = pa.schema([("lang", pa.string()), ("bits", pa.binary())])
    width = len(chosen)
    columns = np.full(1 << SPACE_BITS, width, np.int64)
    columns[chosen] = np.arange(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i in range(0, len(batch), ROWS):
                j = min(len(batch), i + ROWS)
                packed = np.packbits(_presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], columns, width), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([x.tobytes() for x in packed], pa.binary())], schema=schema)

    return map_batches(sample.select("text", "lang"), run, "lang string, bits binary")


def fit(sample: DataFrame) -> Model:
    """Fit the one-against-rest regression on a bounded sample of rows (text, lang).

    The executors make presence rows and their kernels with the landmarks; the driver
    gets the landmarks' rows and one number a row and landmark. Landmarks are the rows
    of each language with the least digests.
    """
    names = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    chosen = _vocabulary(sample) if names else np.zeros(0, np.int64)
    width = len(chosen)
    columns = np.full(1 << SPACE_BITS, width, np.int64)
    columns[chosen] = np.arange(width)
    if not width:
        return Model(columns, np.zeros((0, 0), np.float32), [])
    scratch = Scratch(sample.sparkSession)
    rows = scratch.write(_rows(sample, chosen))
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(names)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("bits"), "bits"))
    found = rows.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("lang", "rank").select("bits").collect()
    marks = _unpack([r.bits for r in found], width)
    schema = pa.schema([("lang", pa.string()), ("kernels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                kernels = _unpack(part.column(1).to_pylist(), width) @ marks.T
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in kernels], pa.binary())], schema=schema)

    numbers = sorted((r.lang, bytes(r.kernels)) for r in map_batches(rows.select("lang", "bits"), run, "lang string, kernels binary").collect())
    scratch.drop(rows)
    to_marks = np.frombuffer(b"".join(x for _, x in numbers), np.float32).reshape(len(numbers), -1).astype(np.float64)
    return Model(columns, solve(to_marks, marks, np.array([names.index(x) for x, _ in numbers]), len(names)), names)


def solve(to_marks: np.ndarray, marks: np.ndarray, label: np.ndarray, languages: int) -> np.ndarray:
    """Return n-gram weights by language, and a row of constants, from the kernels with the landmarks."""
    # Every language weighs the same, however many rows it has.
    weight = (1 / np.bincount(label))[label][:, None] * len(label) / languages
    target = np.where(label[:, None] == np.arange(languages), 1.0, -1.0)
    to_marks = np.append(to_marks, np.ones((len(to_marks), 1)), axis=1)
    between = np.zeros((len(marks) + 1, len(marks) + 1))
    between[:-1, :-1] = marks @ marks.T
    between[-1, -1] = 1
    solved = np.linalg.solve(to_marks.T @ (weight * to_marks) + RIDGE * len(to_marks) * between + 1e-6 * np.eye(len(between)), to_marks.T @ (weight * target))
    return np.append(marks.T @ solved[:-1], solved[-1:], axis=0).astype(np.float32)


_FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _no_letters(column: pa.Array) -> np.ndarray:
    """Texts without any letter."""
    plain = pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(~plain):
        plain[k] = any(map(str.isalpha, column[k].as_py() or ""))
    return ~plain


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: str = "false") -> DataFrame:
    """Return (doc_id, held_out, lang_pred, score); ``held_out`` is an expression over ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.weights) - 1
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in doc_blocks(offsets, BATCH):
                for i in range(a, b, ROWS):
                    j = min(b, i + ROWS)
                    part = batch.slice(i, j - i)
                    blank = _no_letters(part.column(2))
                    if width > 0:
                        rows = _presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.columns, width).astype(np.float32)
                        scores = rows @ model.weights[:-1] / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1)) + model.weights[-1]
                    else:
                        scores, blank = np.zeros((j - i, 1)), np.ones(j - i, bool)
                    best = scores.argmax(axis=1)
                    value = np.where(blank, 0.0, np.clip((scores[np.arange(j - i), best] + 1) / 2, 0, 1).astype(np.float64))
                    names = [UNKNOWN if none else model.languages[k] for k, none in zip(best.tolist(), blank.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(value)], schema=_FIELDS)

    rows = df.select(integer_id(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(F.col("id").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the rows that have a text and a language."""
    named = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    scratch = Scratch(df.sparkSession)
    parts = df.sparkSession.sparkContext.defaultParallelism
    sample = scratch.write(stratified(named.where("text is not null and lang is not null"), "lang", PER_LANGUAGE, LANGUAGES, MOST_ROWS).select("text", "lang").repartition(parts))
    model = fit(sample)
    scratch.drop(sample)
    return model
