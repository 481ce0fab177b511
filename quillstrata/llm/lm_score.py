"""Stupid-backoff language-model scores of documents against their own corpus.

Documents are dealt into batches by a hash. Each batch counts its distinct n-grams, from
single words to runs of ``order`` words, so that a frequent one leaves a batch once, however often it
occurs; the counts go to n-gram tables partitioned by hash, which add them up and
answer each batch with the corpus counts of its own n-grams. The batch then joins
the answers to its exploded n-grams and sums the scores per document.

A document is scored by the rest of the corpus: its own occurrences are taken out
of every count. The score of a word is c(n-gram) / c(its first n - 1 words) for the longest
n-gram ending with it that occurs elsewhere, c(word) / N for a single word and 1 / N if
even the word does not, times ``BACKOFF`` for each step that it is shorter than ``order``.
N-grams do not go beyond the beginning of a document.

The order is two by default: with triples the shuffle needs more than the budget allows
(the README has the figures).

Defined results: a null or empty text has no words and the score 0; every input
row is a document, so repeated rows count as copies; null and repeated ids are
kept, ids of other than integer types raise ``TypeError``; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import constants, integer_id, mix, utf8, words

#: Bytes of text in a batch; larger inputs have more batches and more tables.
BATCH_BYTES = 12 << 20
BACKOFF = 0.4
#: Words of the longest n-grams.
ORDER = 2
#: Stands for any word, so that its count is the number of words.
ANY = 0x7E57


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Return the n-grams that end at each word by length, 0 where there is none, the words' documents, and the sorted n-grams with counts."""
    data, offsets = utf8(table.column("text"))
    hashes, doc = words(data, offsets)
    levels = [hashes & ~np.uint64(1)]
    for k in range(2, order + 1):
        gram = np.zeros(len(hashes), np.uint64)
        if len(hashes) >= k:
            within = doc[k - 1 :] == doc[: len(doc) - k + 1]
            total = np.zeros(int(within.sum()), np.uint64)
            for j, factor in enumerate(constants(k, 0xB16 + k - 2)):
                total += hashes[j : len(hashes) - k + 1 + j][within] * factor
            gram[k - 1 :][within] = mix(total) | np.uint64(1)
        levels.append(gram)
    grams, counts = np.unique(np.concatenate([levels[0], *(x[x != 0] for x in levels[1:])]), return_counts=True)
    return levels, doc, grams, counts


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        levels, _, grams, counts = _grams(table, order)
        grams, counts = np.append(grams, np.uint64(ANY << 1)), np.append(counts, len(levels[0])).astype("<u4")
        bucket = _bucket(grams, buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        grams, counts, bucket = grams[by_bucket].astype("<u8"), counts[by_bucket], bucket[by_bucket]
        at = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(grams)]
        batch = table.column("batch")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(bucket[at[:-1]], pa.int64()),
                "batch": pa.array([batch] * (len(at) - 1), pa.int64()),
                "grams": pa.array([grams[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                "counts": pa.array([counts[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            }
        )

    return run


def _total(table: pa.Table) -> pa.Table:
    """Add up the counts of one hash bucket and answer every batch in its own order."""
    grams = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("grams")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(back, weights=counts).astype("<u8")[back]
    at = np.cumsum([0, *map(len, grams)]).tolist()
    wide = totals.astype("<u4") if totals.max() < 1 << 32 else totals
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "totals": pa.array([wide[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), "width": pa.array([wide.itemsize] * len(grams), pa.int64())})


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])


def _own(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Occurrences of each n-gram (an index below n) in its own document."""
    _, back, counts = np.unique(doc * n + key, return_inverse=True, return_counts=True)
    return counts[back]


def _score(buckets: int, order: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _SCORES.empty_table()
        levels, doc, grams, _ = _grams(texts, order)
        n_docs, n_words = texts.num_rows, len(doc)
        by_bucket = np.argsort(_bucket(np.append(grams, np.uint64(ANY << 1)), buckets), kind="stable")
        answers = answers.sort_by("bucket")
        found = [np.frombuffer(x.as_buffer(), f"<u{w.as_py()}").astype(np.float64) for x, w in zip(answers.column("totals"), answers.column("width"), strict=True)]
        totals = np.empty(len(grams) + 1)
        totals[by_bucket] = np.concatenate(found)
        n = np.bincount(doc, minlength=n_docs)
        left = totals[-1] - n[doc]
        # Scores of the longest n-gram that occurs elsewhere; longer ones replace shorter ones.
        score = np.log(BACKOFF) * order - np.log(np.maximum(left, 1.0))
        before = left
        for k, level in enumerate(levels, 1):
            has = np.flatnonzero(level) if k > 1 else np.arange(n_words)
            at = np.searchsorted(grams, level[has])
            rest = np.zeros(n_words)
            rest[has] = totals[at] - _own(at, doc[has], len(grams))
            seen = rest > 0
            score[seen] = np.log(rest[seen]) - np.log(np.maximum(before[seen], 1.0)) + np.log(BACKOFF) * (order - k)
            before = np.append(0.0, rest[:-1]) if n_words else rest
        total = np.bincount(doc, weights=score, minlength=n_docs)
        return pa.table([texts.column("doc_id"), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], schema=_SCORES)

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Return (doc_id, n_words, log_score, mean_log_score), one row an input row."""
    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / BATCH_BYTES))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("long"))
    counted = dealt.groupBy("batch").applyInArrow(_count(batches, order), "bucket long, batch long, grams binary, counts binary")
    totals = counted.groupBy("bucket").applyInArrow(_total, "batch long, bucket long, totals binary, width long")
    return dealt.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(_score(batches, order), "doc_id long, n_words long, log_score double, mean_log_score double")
