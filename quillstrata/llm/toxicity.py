"""Toxicity scores from a weighted lexicon.

Texts are folded (case, look-alike letters, digits that stand for letters), then
one Aho-Corasick pass finds all lexicon entries that begin a word. Occurrences
inside an exception phrase do not count. The summed weight and the length of the
text give the score through a logistic curve, so that one entry weighs less in a
longer text.

The lexicon is learned: word beginnings of ``SHORTEST`` to ``LONGEST`` letters that
occur in many different contexts of texts labelled toxic and hardly in others, each
with its log odds ratio. Contexts, not texts, are counted, so that copies of one text
add nothing. Exception phrases are learned, too: a word with an entry and a word beside
it that together occur in texts that are not toxic and mark no toxic ones. Training
takes about ``PER_LABEL`` rows of each label, a documented bound; their texts stay on
the executors, which count beginnings, phrases and weights; the driver gets the
surviving entries and phrases, and two numbers a row for the curve.

Defined results: a label of 1 is toxic, every other label is not, null labels are
unlabelled; null and empty texts are scored by their length (0) alone; a table
without labels gives an empty lexicon and the score 0; repeated rows and repeated or
null ids are scored each; ids of a type other than integers raise ``TypeError``; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import SLICE, doc_blocks, integer_id, map_batches, span_hashes, utf8
from quillstrata.llm.samples import stratified
from quillstrata.sources import Scratch

#: Rows that training uses of each label.
PER_LABEL = 3000
#: Letters of the word beginnings that may become entries.
SHORTEST, LONGEST = 4, 14
#: An entry needs so many contexts and texts, and log odds that exceed their standard error by this.
CONTEXTS, TEXTS, ODDS = 5, 5, 2.2
#: A longer beginning replaces a shorter one if it has this share of its texts.
SAME = 0.9
#: Letters that an exception phrase has at most.
PHRASE = 64
# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕһԁӏυοανρтмкнвⅼ", "aeopcyxijshdluoavptmkhbl", strict=True))
DIGITS = dict(zip("013457@", "oieasta", strict=True))


@functools.cache
def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()}
    return table | {0xFF41 + k: chr(97 + k) for k in range(26)}


def fold(text: str) -> str:
    """Return the text in lower case with look-alikes and digit substitutions undone."""
    return text.lower().translate(_fold_table())


@dataclass
class Model:
    """Entries with weights, exception phrases and the curve's coefficients."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Return bytes of folded texts and (start, end, text index) of their runs of letters."""
    data, offsets = utf8(pa.array([fold(x.as_py() or "") for x in texts], pa.string()))
    if not len(data):
        return data, *(np.zeros(0, np.int64),) * 3
    letter = np.zeros(256, bool)
    letter[[*range(97, 123), *range(0x80, 0x100)]] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = letter[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def _beginnings(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Find the word beginnings of a block of texts, one size at a time.

    Yields (text, hash of the preceding word, index of the beginning) of each
    occurrence, and the distinct beginnings.
    """
    data, starts, ends, doc = _tokens(texts)
    if not len(starts):
        return
    letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(letters, starts)
    count = np.searchsorted(letters, ends) - at
    before = np.append(np.uint64(0), span_hashes(data, starts, ends)[:-1])
    before[np.searchsorted(doc, np.unique(doc))] = 0
    for size in range(SHORTEST, LONGEST + 1):
        has = np.flatnonzero(count >= size)
        if not len(has):
            break
        stop = letters[at[has] + size]
        _, one, back = np.unique(span_hashes(data, starts[has], stop), return_index=True, return_inverse=True)
        spans = zip(starts[has][one].tolist(), stop[one].tolist(), strict=True)
        yield doc[has], before[has], back, [data[a:b].tobytes() for a, b in spans]


def _grow(chosen: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Keep of each family of beginnings the longest one that has nearly all texts of the shortest."""
    longer: dict[str, list[str]] = {}
    for text in sorted(chosen):
        longer.setdefault(text[:-1], []).append(text)
    entries: dict[str, float] = {}
    roots: set[str] = set()
    for root in sorted(chosen, key=lambda x: (len(x), x)):
        if any(root[:k] in roots for k in range(SHORTEST, len(root))):
            continue
        roots.add(root)
        best, grown = root, True
        while grown:
            kept = [x for x in longer.get(best, ()) if chosen[x][0] >= SAME * chosen[root][0]]
            best, grown = (kept[0], True) if kept else (best, False)
        entries[best] = chosen[best][1]
    return entries


def _odds(n1: int, n0: int) -> tuple:
    """Log odds ratio of columns in1 and in0, and its standard error."""
    odds = F.log(((F.col("in1") + 0.5) / (n1 + 1)) / ((F.col("in0") + 0.5) / (n0 + 1)))
    return odds, F.sqrt(1 / (F.col("in1") + 0.5) + 1 / (F.col("in0") + 0.5))


def _count_texts(sample: DataFrame) -> DataFrame:
    """Return (root, in1, in0): the toxic and other texts of each block that have a word beginning."""
    schema = pa.schema([("root", pa.string()), ("in1", pa.int64()), ("in0", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, label = utf8(batch.column(0))[1], batch.column(1).to_numpy()
            for i, j in doc_blocks(offsets, 4 * SLICE):
                for doc, _, back, roots in _beginnings(batch.column(0).slice(i, j - i)):
                    pairs = np.unique(back * np.int64(j - i) + doc)
                    owner, toxic = pairs // (j - i), label[i:j][pairs % (j - i)]
                    sums = (np.bincount(owner, weights=x, minlength=len(roots)).astype(np.int64) for x in (toxic, 1 - toxic))
                    yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()).cast(pa.string()), *map(pa.array, sums)], schema=schema)

    return map_batches(sample.select("text", "toxic"), run, "root string, in1 long, in0 long")


def _contexts(sample: DataFrame, wanted: frozenset[bytes]) -> DataFrame:
    """Return (root, context): the preceding words of the wanted beginnings in toxic texts, distinct by block."""
    schema = pa.schema([("root", pa.string()), ("context", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).filter(pa.array(batch.column(1).to_numpy() == 1))
            offsets = utf8(texts)[1]
            for i, j in doc_blocks(offsets, 4 * SLICE):
                for _, before, back, roots in _beginnings(texts.slice(i, j - i)):
                    known = np.array([x in wanted for x in roots], bool)[back]
                    if known.any():
                        own, context = np.unique(np.stack([back[known].astype(np.uint64), before[known]]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array([roots[k] for k in own.tolist()], pa.binary()).cast(pa.string()), pa.array(context.view(np.int64))], schema=schema)

    return map_batches(sample.select("text", "toxic"), run, "root string, context long")


def learn_entries(sample: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """Return the word beginnings that mark the toxic rows of (text, toxic), with log odds ratios."""
    odds, error = _odds(n1, n0)
    counted = _count_texts(sample).groupBy("root").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    marks = counted.where((F.col("in1") >= TEXTS) & (odds - error >= ODDS)).select("root", "in1", odds.alias("odds"))
    found = {r.root: (r.in1, r.odds) for r in marks.collect()}
    spread = _contexts(sample, frozenset(x.encode() for x in found)).distinct().groupBy("root").count().where(F.col("count") >= CONTEXTS)
    return _grow({r.root: found[r.root] for r in spread.select("root").collect()})


def _phrases(folded: str, engine) -> set[str]:
    """Return each word with an entry together with the word before and the one after it."""
    found = set()
    for end, (size, _) in engine.iter(folded) if len(engine) else ():
        start = end - size + 1
        if start and folded[start - 1].isalpha():
            continue
        stop = end + 1
        while stop < len(folded) and folded[stop].isalpha() and stop - start <= PHRASE:
            stop += 1
        low, high = start - 1, stop + 1
        while low > 0 and folded[low - 1].isalpha() and stop - low <= PHRASE:
            low -= 1
        while high < len(folded) and folded[high].isalpha() and high - start <= PHRASE:
            high += 1
        if start and folded[start - 1] == " " and low < start - 1:
            found.add(folded[low:stop])
        if high > stop + 1 and folded[stop] == " ":
            found.add(folded[start:high])
    return {x for x in found if len(x) <= PHRASE}


def learn_exceptions(sample: DataFrame, entries: dict[str, float], n1: int, n0: int) -> tuple[str, ...]:
    """Return the phrases with an entry that occur in other rows of (text, toxic) and mark no toxic ones."""
    schema = pa.schema([("phrase", pa.string()), ("in1", pa.int64()), ("in0", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _automaton(entries, ())
        for batch in batches:
            found = [(x, toxic) for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for x in sorted(_phrases(fold(text.as_py() or ""), engine))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), *(pa.array([abs(t - k) for _, t in found], pa.int64()) for k in (0, 1))], schema=schema)

    rows = map_batches(sample.select("text", "toxic"), run, "phrase string, in1 long, in0 long")
    odds, error = _odds(n1, n0)
    counted = rows.groupBy("phrase").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    kept = counted.where((F.col("in0") >= TEXTS) & (odds + error < 0))
    return tuple(sorted(r.phrase for r in kept.select("phrase").collect()))


def _automaton(entries: dict[str, float], exceptions: tuple[str, ...]):
    import ahocorasick

    engine = ahocorasick.Automaton()
    for text, weight in entries.items():
        engine.add_word(text, (len(text), weight))
    for text in exceptions:
        engine.add_word(text, (len(text), -1.0))
    engine.make_automaton()
    return engine


def weigh(text: str, engine) -> tuple[float, int]:
    """Return (summed weight of counted entries, number of words)."""
    folded = fold(text)
    hits, spared = [], []
    for end, (size, weight) in engine.iter(folded) if len(engine) else ():
        start = end - size + 1
        if start and folded[start - 1].isalpha():
            continue
        (spared if weight < 0 else hits).append((start, end, weight))
    if spared:
        spared.sort()
        opens, reach, most = [a for a, _, _ in spared], [], -1
        for _, b, _ in spared:
            most = max(most, b)
            reach.append(most)
        hits = [(s, e, w) for s, e, w in hits if not (k := bisect_right(opens, s)) or reach[k - 1] < e]
    return sum(w for _, _, w in hits), text.count(" ") + text.count("\n") + bool(text)


def _features(total: float, n_words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(n_words)


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Fit the logistic curve on rows of (log weight, log words)."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([0.02, 0.02, 1e-4]) * len(x) / 100
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3), x.T @ (toxic - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def _weights(sample: DataFrame, entries: dict[str, float], exceptions: tuple[str, ...]) -> DataFrame:
    """Return (weight, words, toxic): the curve's numbers of each row of (text, toxic)."""
    schema = pa.schema([("weight", pa.float64()), ("words", pa.float64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _automaton(entries, exceptions)
        for batch in batches:
            pairs = [_features(*weigh(text.as_py() or "", engine)) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)), batch.column(1)], schema=schema)

    return map_batches(sample.select("text", "toxic"), run, "weight double, words double, toxic long")


def fit(sample: DataFrame) -> Model:
    """Learn the lexicon, the exceptions and the curve from rows of (text, toxic 0 or 1).

    The numbers of the curve are collected, so ``sample`` must be bounded.
    """
    counts = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 + n0:
        return Model({}, (), (0.0, 0.0, -30.0))
    entries = learn_entries(sample, n1, n0) if n1 else {}
    exceptions = learn_exceptions(sample, entries, n1, n0) if entries else ()
    numbers = np.array(sorted(map(tuple, _weights(sample, entries, exceptions).collect())), float)
    return Model(entries, exceptions, fit_curve(numbers[:, :2], numbers[:, 2]))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of documents with a text and a toxic label."""
    marked = labels.where("toxic is not null").select("doc_id", (F.col("toxic") == 1).cast("long").alias("toxic"))
    joined = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(stratified(marked, "toxic", PER_LABEL)), "doc_id")
    scratch = Scratch(documents.sparkSession)
    sample = scratch.write(joined.select("text", "toxic").repartition(documents.sparkSession.sparkContext.defaultParallelism))
    model = fit(sample)
    scratch.drop(sample)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: str = "false") -> DataFrame:
    """Return (doc_id, held_out, score, predicted); ``held_out`` is an expression over ``doc_id``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _automaton(model.entries, model.exceptions)
        a, b, c = model.curve
        for batch in batches:
            out = np.empty(len(batch))
            for k, text in enumerate(batch.column(2)):
                u, v = _features(*weigh(text.as_py() or "", engine))
                out[k] = a * u + b * v + c
            p = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Return the rows of ``df`` that are not predicted toxic, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _automaton(model.entries, model.exceptions)
        a, b, c = model.curve
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                u, v = _features(*weigh(text.as_py() or "", engine))
                keep.append(a * u + b * v + c < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(df, run, df.schema)
