"""Quality classification by a generalised additive model with interactions.

The log odds are a sum of one lookup table per feature and one per chosen pair of
features. Tables are learned by cyclic boosting: each round passes once over all
features and adds a shallow tree, fitted to the current residuals, to the table of
one feature at a time; pairs are chosen by what is left and boosted likewise.
Scoring is a binning and an addition of table entries for whole arrays.

Training takes about ``PER_LABEL`` rows of each label, a documented bound. Defined
results: a label of 1 is good, every other label is not, null labels are unlabelled;
null and empty texts are scored by their features, all zero; a table without labels
gives the score 0.5; repeated rows and repeated or null ids are scored each; ids of a
type other than integers raise ``TypeError``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import SLICE, doc_blocks, integer_id, map_batches, shingle_sets, span_hashes, utf8, word_spans
from quillstrata.llm.samples import stratified

#: Rows that training uses of each label.
PER_LABEL = 4000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 250, 100, 6
RATE, LEAVES, LEAST = 0.1, 3, 20
FEATURES = ("bytes", "words", "word_length", "upper", "exclaim", "pipe", "signs", "digits", "other", "newlines", "distinct", "repeats", "line_repeats")


def _classes() -> list[np.ndarray]:
    """Byte tables of the character classes that features count."""
    sets = [range(65, 91), b"!", b"|", b"#$%&*", range(48, 58), range(128, 256), b"\n"]
    tables = np.zeros((len(sets), 256), bool)
    for table, members in zip(tables, sets, strict=True):
        table[list(members)] = True
    return list(tables)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Return one row of ``FEATURES`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    full = np.flatnonzero(size > 0)
    begin = offsets[:-1][full]
    shares = np.zeros((n, 7))
    for k, table in enumerate(_classes()):
        shares[full, k] = np.add.reduceat(table[data], begin, dtype=np.int64)
    newlines = shares[:, 6].copy()
    shares /= np.maximum(size, 1)[:, None]
    starts, ends, doc = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    words = np.bincount(doc, minlength=n)
    distinct = np.diff(shingle_sets(hashes, doc, n, 1)[1])
    again = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc[1:][again], minlength=n)
    breaks = np.flatnonzero(data == 10)
    cut = np.union1d(begin, breaks[breaks + 1 < len(data)] + 1)
    stop = np.append(cut[1:], len(data))
    lines = np.searchsorted(offsets, cut, "right") - 1
    line_sets = np.diff(shingle_sets(span_hashes(data, cut, stop), lines, n, 1)[1])
    line_counts = np.bincount(lines, minlength=n)
    many = np.maximum(words, 1)
    out[:] = np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            size / many,
            shares[:, :6],
            newlines / many,
            distinct / many,
            repeats / many,
            np.where(line_counts > 0, 1 - line_sets / np.maximum(line_counts, 1), 0),
        ]
    )
    return out


@dataclass
class Model:
    """Bin edges, tables of features and of pairs, and the constant."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Return the probability of label 1 for rows of features."""
        total = np.full(len(x), self.constant)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fit a tree of at most ``LEAVES`` leaves to binned sums; return its values by bin."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for a, b in leaves:
            if b - a < 2:
                continue
            cg, ch, cn = (np.cumsum(v[a:b])[:-1] for v in (g, h, n))
            tg, th, tn = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
            gain[(cn < LEAST) | (tn - cn < LEAST)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Return (gain, values) of the best tree of one cut on each axis of a pair."""
    cg, ch = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h))
    tg, th = cg[-1, -1], ch[-1, -1]
    corner_g, corner_h = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    right_g, right_h = cg[1:-1, -1:] - corner_g, ch[1:-1, -1:] - corner_h
    low_g, low_h = cg[-1:, 1:-1] - corner_g, ch[-1:, 1:-1] - corner_h
    rest_g, rest_h = tg - corner_g - right_g - low_g, th - corner_h - right_h - low_h
    if not corner_g.size:
        return 0.0, np.zeros_like(g)
    gain = _gain(corner_g, corner_h) + _gain(right_g, right_h) + _gain(low_g, low_h) + _gain(rest_g, rest_h)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for rows, cols, sg, sh in ((slice(0, i + 1), slice(0, j + 1), corner_g, corner_h), (slice(0, i + 1), slice(j + 1, None), right_g, right_h), (slice(i + 1, None), slice(0, j + 1), low_g, low_h), (slice(i + 1, None), slice(j + 1, None), rest_g, rest_h)):
        out[rows, cols] = sg[i, j] / (sh[i, j] + 1.0)
    return float(gain[i, j] - _gain(tg, th)), out


def fit(x: np.ndarray, label: np.ndarray, prior: float | None = None) -> Model:
    """Boost the tables on rows of features; ``prior`` is the share of label 1 outside the sample."""
    count = x.shape[1]
    if not len(x) or label.min() == label.max():
        constant = 0.0 if not len(x) else (4.0 if label[0] else -4.0)
        empty = [np.zeros(0)] * count
        return Model(empty, empty, [np.zeros(1)] * count, [], [], constant)
    share = label.mean()
    prior = share if prior is None else prior
    weight = np.where(label == 1, prior / share, (1 - prior) / (1 - share))
    edges, coarse = ([_edges(x[:, k], bins) for k in range(count)] for bins in (BINS, PAIR_BINS))
    bins = [np.searchsorted(edges[k], x[:, k], "right") for k in range(count)]
    rough = [np.searchsorted(coarse[k], x[:, k], "right") for k in range(count)]
    constant = float(np.log(prior / (1 - prior)))
    total = np.full(len(x), constant)
    tables = [np.zeros(len(e) + 1) for e in edges]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (label - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(tables):
            g, h = (np.bincount(bins[k], weights=v, minlength=len(table)) for v in slopes())
            step = RATE * _tree(g, h, counts[k])
            table += step
            total += step[bins[k]]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cell = rough[a] * shape[1] + rough[b]
        g, h = (np.bincount(cell, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in slopes())
        return g, h

    ranked = sorted(((_quadrants(*sums(a, b))[0], a, b) for a in range(count) for b in range(a + 1, count)), reverse=True)
    pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            step = RATE * _quadrants(*sums(a, b))[1]
            table += step
            total += step[rough[a], rough[b]]
    return Model(edges, coarse, tables, pairs, pair_tables, constant)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of documents with a text and a quality label.

    The executors compute the features; the driver gets ``FEATURES`` numbers a row.
    """
    marked = labels.where("quality is not null").select("doc_id", (F.col("quality") == 1).cast("long").alias("quality"))
    counts = dict(marked.groupBy("quality").count().collect())
    joined = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(stratified(marked, "quality", PER_LABEL)), "doc_id")
    schema = pa.schema([("x", pa.list_(pa.float64())), ("quality", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in doc_blocks(offsets, 4 * SLICE):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(i, j - i)], schema=schema)

    rows = sorted((*r.x, r.quality) for r in map_batches(joined.select("text", "quality"), run, "x array<double>, quality long").collect())
    numbers = np.array(rows, float).reshape(len(rows), len(FEATURES) + 1)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(numbers[:, :-1], numbers[:, -1].astype(np.int64), prior if 0 < prior < 1 else None)


def score(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", held_out: str = "false") -> DataFrame:
    """Return (doc_id, held_out, score, predicted); ``held_out`` is an expression over ``doc_id``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in doc_blocks(offsets, 4 * SLICE):
                p = model.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
