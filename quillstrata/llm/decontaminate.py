"""Benchmark decontamination by SimHash windows.

Words are runs of letters and digits, A-Z lower-cased; passages are compared by
five-word shingles. Every window of a document that has an item's number of words
and holds at least one shingle of some item (no other can be similar) gets a 64-bit
SimHash from running sums of its shingles' weighted bits, unless shingles of items
make up less than 0.8 of its weight, which bounds its similarity to any item. A document
of fewer words than an item is itself the window that is held against it. Multi-index Hamming
lookup finds all items within ``RADIUS``: of eight blocks of eight bits, one must
differ in at most two bits if all differ in at most 23. Candidates are verified by
exact weighted Jaccard similarity of window and item.

A shingle weighs as many characters as its words have, so that five long words count
for more than five short ones, whatever else the benchmark holds. At the least similarity of 0.8 two fingerprints differ in 9.7 bits on average, and in more
than 23 with probability below 1e-5.

Items are read in blocks of bounded size, each sent to all tasks and held against
all documents. Defined results: null and empty texts and items match nothing; items
shorter than a shingle are compared as a whole sequence; equal items are all
reported; repeated documents are reported each; ids of a type other than integers raise
``TypeError``; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import SLICE, constants, doc_blocks, integer_id, map_batches, mix, span_hashes, utf8
from quillstrata.llm.tokens import ragged

SHINGLE, SIMILAR = 5, 0.8
RADIUS, BLOCKS, NEAR = 23, 8, 2
#: Items, and characters of them, that are held against the documents at once (one longer item stands alone).
ITEMS, CHARACTERS = 5000, 8 << 20
#: Bits of the bitmap that rules out most shingles.
FILTER_BITS = 20
#: Windows fingerprinted at once, and pairs of a window and an item looked up at once.
WINDOWS, PAIRS = 1 << 14, 1 << 22


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return (hash, bytes, text index) of every run of letters and digits."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _word_table()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, starts, ends), ends - starts, np.searchsorted(offsets, starts, "right") - 1


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Return the hash of the ``size`` words that begin at each word (fewer at the end)."""
    factors = constants(size, 0x9D)
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        out[: len(hashes) - k] += hashes[k:] * factors[k]
    return mix(out)


def weights(lengths: np.ndarray, size: int) -> np.ndarray:
    """Return the bytes of the ``size`` words that begin at each word (fewer at the end)."""
    sums = np.append(0, np.cumsum(lengths))
    at = np.arange(len(lengths))
    return (sums[np.minimum(at + size, len(lengths))] - sums[at]).astype(np.float64)


@dataclass
class Items:
    """Benchmark items prepared for lookup."""

    ids: list[int | None]
    sizes: np.ndarray
    shingles: list[np.ndarray]
    weights: list[np.ndarray]
    masses: np.ndarray
    known: np.ndarray
    owners: np.ndarray
    owned: np.ndarray
    bitmap: np.ndarray
    prints: np.ndarray


def _bits(values: np.ndarray) -> np.ndarray:
    """Return +1 or -1 for each of the 64 bits of a shingle."""
    raw = np.unpackbits(mix(values + np.uint64(0xF1)).view(np.uint8).reshape(-1, 8), axis=1)
    return raw.astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def prepare(ids: list[int | None], texts: list[str]) -> Items:
    """Prepare a block of items; those without words are left out."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    hashes, lengths, doc = tokens(data, offsets)
    counts = np.bincount(doc, minlength=len(ids)) if len(doc) else np.zeros(len(ids), np.int64)
    begin = np.cumsum(counts) - counts
    keep = np.flatnonzero(counts > 0)
    shingles, heavy = [], []
    for k in keep:
        part, size = slice(begin[k], begin[k] + counts[k]), min(SHINGLE, int(counts[k]))
        n = int(counts[k]) - size + 1
        shingles.append(grams(hashes[part], size)[:n])
        heavy.append(weights(lengths[part], size)[:n])
    known, back = np.unique(np.concatenate(shingles) if shingles else np.zeros(0, np.uint64), return_inverse=True)
    # The items that have a known shingle: owners[owned[s] : owned[s + 1]].
    has = np.unique(back * np.int64(len(keep) + 1) + np.repeat(np.arange(len(keep)), [len(x) for x in shingles]))
    owners, owned = has % (len(keep) + 1), np.searchsorted(has // (len(keep) + 1), np.arange(len(known) + 1))
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[(known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    prints = [_pack((_bits(x) * w[:, None]).sum(axis=0, keepdims=True, dtype=np.float64)) for x, w in zip(shingles, heavy, strict=True)]
    return Items([ids[k] for k in keep], counts[keep], shingles, heavy, np.array([x.sum() for x in heavy]), known, owners, owned, bitmap, np.concatenate(prints) if prints else np.zeros((0, 8), np.uint8))


def _similar(window: np.ndarray, heavy: np.ndarray, item: np.ndarray, item_heavy: np.ndarray) -> float:
    """Exact weighted Jaccard similarity of two multisets of shingles."""
    both, first, back = np.unique(np.concatenate([window, item]), return_index=True, return_inverse=True)
    w = np.concatenate([heavy, item_heavy])[first]
    a = np.bincount(back[: len(window)], minlength=len(both))
    b = np.bincount(back[len(window) :], minlength=len(both))
    return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())


def search(hashes: np.ndarray, lengths: np.ndarray, doc: np.ndarray, items: Items) -> list[tuple[int, int, float, int, int]]:
    """Return (text index, item index, similarity, first word, words): the best window of each pair."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(hashes) or not items.ids:
        return []
    counts = np.bincount(doc)
    ends = np.cumsum(counts)
    begin, end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
    for short in sorted({min(SHINGLE, int(n)) for n in items.sizes}):
        values = grams(hashes, short)
        maybe = np.flatnonzero(items.bitmap[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        maybe = maybe[maybe + short <= end[maybe]]
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(items.known, values[maybe]), len(items.known) - 1)
        hits = maybe[items.known[at] == values[maybe]]
        if not len(hits):
            continue
        heavy = weights(lengths, short)
        known = np.zeros(len(heavy))
        known[hits] = heavy[hits]
        places = _Places(hits, at[items.known[at] == values[maybe]], heavy, items)
        mass, shared = (np.append(0.0, np.cumsum(x)) for x in (heavy, known))
        for length in sorted({int(n) for n in items.sizes if min(SHINGLE, int(n)) == short}):
            span = length - short + 1
            lowest = np.maximum(hits - span + 1, begin[hits])
            opens = np.unique(ragged(np.arange(len(hashes)), lowest, hits - lowest + 1))
            opens = opens[opens + length <= end[opens]]
            opens = opens[shared[opens + span] - shared[opens] >= SIMILAR * (mass[opens + span] - mass[opens])]
            members = np.flatnonzero(items.sizes == length)
            for chunk in range(0, len(opens), WINDOWS):
                _windows(opens[chunk : chunk + WINDOWS], span, length, values, heavy, doc, begin, members, items, places, best)
        # A text shorter than an item is one window, if its known shingles can reach the item's weight.
        opens = np.unique(begin[hits])
        size = end[opens] - opens
        whole = opens + size - short + 1
        known_mass = shared[whole] - shared[opens]
        keep = (size < items.sizes.max()) & (known_mass >= SIMILAR * (mass[whole] - mass[opens]))
        opens, size, known_mass = opens[keep], size[keep], known_mass[keep]
        for length in np.unique(size).tolist():
            same = size == length
            longer = (items.sizes > length) & (np.minimum(SHINGLE, items.sizes) == short)
            members = np.flatnonzero(longer & (SIMILAR * items.masses <= known_mass[same].max() + 1e-6))
            if len(members):
                part = opens[same]
                for chunk in range(0, len(part), WINDOWS):
                    _windows(part[chunk : chunk + WINDOWS], length - short + 1, length, values, heavy, doc, begin, members, items, places, best)
    return [(d, k, s, -back, n) for (d, k), (s, back, n) in sorted(best.items())]


class _Places:
    """Where the shingles of each item stand in some texts, with running sums of their weights."""

    def __init__(self, hits: np.ndarray, shingle: np.ndarray, heavy: np.ndarray, items: Items) -> None:
        many = items.owned[shingle + 1] - items.owned[shingle]
        item, at = ragged(items.owners, items.owned[shingle], many), np.repeat(hits, many)
        order = np.argsort(item, kind="stable")
        self.at, item = at[order], item[order]
        self.sums = np.append(0.0, np.cumsum(heavy[self.at]))
        self.begin = np.searchsorted(item, np.arange(len(items.sizes) + 1))

    def most(self, item: int, opens: np.ndarray, span: int) -> np.ndarray:
        """Weight of each window's shingles that the item has: no intersection weighs more."""
        a, b = self.begin[item], self.begin[item + 1]
        part = self.at[a:b]
        return self.sums[a + np.searchsorted(part, opens + span)] - self.sums[a + np.searchsorted(part, opens)]


def _windows(opens, span, length, values, heavy, doc, begin, members, items, places, best) -> None:
    """Fingerprint windows by running sums, look them up and verify."""
    if not len(opens) or not len(members):
        return
    breaks = np.flatnonzero(np.diff(opens) > span) + 1
    prints = np.empty((len(opens), 8), np.uint8)
    mass = np.empty(len(opens))
    for run in np.split(np.arange(len(opens)), breaks):
        lo, hi = opens[run[0]], opens[run[-1]] + span
        signed = _bits(values[lo:hi]) * heavy[lo:hi, None]
        sums = np.zeros((hi - lo + 1, 64))
        np.cumsum(signed, axis=0, out=sums[1:], dtype=np.float64)
        start = opens[run] - lo
        prints[run] = _pack(sums[start + span] - sums[start])
        total = np.append(0.0, np.cumsum(heavy[lo:hi]))
        mass[run] = total[start + span] - total[start]
    own = items.prints[members]
    # near[b][v, k] says that block b of item k is within NEAR bits of v.
    distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    near = [distance[:, own[:, b]] <= NEAR for b in range(BLOCKS)]
    for at in range(0, len(opens), max(1, PAIRS // len(members))):
        part = slice(at, at + max(1, PAIRS // len(members)))
        found = near[0][prints[part, 0]]
        for b in range(1, BLOCKS):
            found |= near[b][prints[part, b]]
        window, item = np.nonzero(found)
        close = np.bitwise_count(prints[part][window] ^ own[item]).sum(axis=1) <= RADIUS
        order = np.argsort(item[close], kind="stable")
        window, item = window[close][order] + at, members[item[close][order]]
        edges = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        for i, j in itertools.pairwise(edges.tolist()):
            k, some = int(item[i]), window[i:j]
            some = some[places.most(k, opens[some], span) >= SIMILAR * np.maximum(mass[some], items.masses[k]) - 1e-6]
            for w in some.tolist():
                first = int(opens[w])
                s = _similar(values[first : first + span], heavy[first : first + span], items.shingles[k], items.weights[k])
                pair = (int(doc[first]), k)
                place = (s, int(begin[first]) - first, length)
                if s >= SIMILAR - 1e-9 and place[:2] > best.get(pair, (0.0, 0))[:2]:
                    best[pair] = place


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Read items in blocks; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(integer_id(benchmark, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        if ids and (len(ids) == ITEMS or size + len(row.text) > CHARACTERS):
            yield prepare(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield prepare(ids, texts)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Return (doc_id, item_id, similarity, first_word, n_words): the best window of each pair.

    Only pairs of at least ``SIMILAR`` are returned, of equal windows the first. A null item
    id stays null.
    """
    rows = documents.select(integer_id(documents, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context = documents.sparkSession.sparkContext
    result = None
    for items in _blocks(benchmark, item_col, item_text_col):
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for i, j in doc_blocks(offsets, 2 * SLICE):
                    found = search(*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shared.value)
                    ids = batch.column(0).slice(i, j - i)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([f[0] for f in found], pa.int64())),
                            pa.array([shared.value.ids[f[1]] for f in found], pa.int64()),
                            *(pa.array([f[c] for f in found], t) for c, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
                        ],
                        schema=_FOUND,
                    )

        part = map_batches(rows, run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        result = part if result is None else result.unionByName(part)
    return result if result is not None else rows.where("false").selectExpr("doc_id", "cast(null as long) item_id", "cast(null as double) similarity", "cast(null as long) first_word", "cast(null as long) n_words")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Return the rows of ``documents`` that hold no item, with all columns."""
    context = documents.sparkSession.sparkContext
    for items in _blocks(benchmark, item_col, item_text_col):
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
                for i, j in doc_blocks(offsets, 2 * SLICE):
                    keep = np.ones(j - i, bool)
                    keep[[f[0] for f in search(*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shared.value)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        documents = map_batches(documents, run, documents.schema)
    return documents
