"""Audit of how the sources of a language differ, by joint count histograms.

Terms are runs of letters A-Z, lower-cased, and of all characters beyond ASCII. A
language keeps the terms that occur in enough of its documents. Each (language,
source) group and each language gives a kept term that it has c times, of N in all,
the weight p = 1 + floor(SCALE * (c + ADD) / (N + ADD * V)), where V is the number of
kept terms.

The divergence of two sources is the sum of |p - q| over all kept terms. It depends on
each term through its two counts alone, so that for each pair of sources the distinct
(count, count) combinations are tallied and |p - q| is evaluated once for each, times
the tally. Combinations with a zero are not enumerated: how many terms have count c in
one source and none in the other is what the source's own histogram has beyond the
joint one, and (0, 0) is what is left of V.

A group whose language is the same gives a term part, too: the terms that it has in
excess of its language, ranked.

Defined results: null texts, languages and sources are empty strings; every input row
is a document, so repeated rows count each; a group without terms has all counts zero;
where no term is kept, divergences are 0 and there is no term part; other columns are
ignored; an empty table gives no rows. All arithmetic is on integers (decimals of 38
digits where products are formed). Ties rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import doc_blocks, lower_table, map_batches, utf8
from quillstrata.sources import Scratch

SCALE = 1_000_000_000
ADD = 5
#: Documents of a language that a kept term occurs in, at least.
DOCUMENTS = 30
#: Terms of a group that the term part lists; the pair part lists all sources.
RANKS = 50
#: Bytes of text tokenised at once.
BLOCK = 2 << 20
#: Counts of one block of terms that are compared at once.
CELLS = 200_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Return (term, document index) of every term of a block of UTF-8 texts."""
    low = lower_table()[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (low >= 0x80) | ((low >= 0x61) & (low <= 0x7A))
    # The end of a document ends a run; empty texts share their edges.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=lengths[1:])
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(low[inside[1:-1]].tobytes())])
    return found, np.searchsorted(offsets, starts, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (language, source, term) of a block of documents."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in doc_blocks(offsets, BLOCK):
            at = offsets[i : j + 1] - offsets[i]
            found, doc = terms(data[offsets[i] : offsets[j]], at)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            of_doc, in_doc = np.unique(doc * len(names) + code, return_counts=True)
            group = pa.StructArray.from_arrays([batch.column("lang").slice(i, j - i), batch.column("source").slice(i, j - i)], names=["lang", "source"])
            pairs, number = _distinct(group)
            key, back = np.unique(number[of_doc // len(names)] * len(names) + of_doc % len(names), return_inverse=True)
            n = np.bincount(back, weights=in_doc).astype(np.int64)
            docs = np.bincount(back).astype(np.int64)
            who = pairs.take(pa.array(key // len(names)))
            yield pa.RecordBatch.from_arrays([who.field("lang"), who.field("source"), names.take(pa.array(key % len(names))).cast(pa.string()), pa.array(n), pa.array(docs)], schema=_COUNTS)


def _distinct(values: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """Return the distinct (language, source) pairs and the number of each row's pair."""
    coded = [values.field(k).dictionary_encode() for k in range(2)]
    codes = [c.indices.to_numpy().astype(np.int64) for c in coded]
    width = max(1, len(coded[1].dictionary))
    key, back = np.unique(codes[0] * width + codes[1], return_inverse=True)
    parts = [coded[0].dictionary.take(pa.array(key // width)), coded[1].dictionary.take(pa.array(key % width))]
    return pa.StructArray.from_arrays(parts, names=["lang", "source"]), back


def _tally(table: pa.Table) -> pa.Table:
    """Joint histograms of every pair of sources over the terms of one block.

    The block is a matrix of terms by sources, as wide as the sources that occur in it.
    """
    lang = table.column("lang")[0]
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    coded = table.column("source").combine_chunks().dictionary_encode()
    source = coded.indices.to_numpy()
    n = table.column("n").to_numpy()
    counts, rank = np.unique(n, return_inverse=True)
    order = np.lexsort((term, source))
    edges = np.searchsorted(source[order], np.arange(len(coded.dictionary) + 1))
    names, width = coded.dictionary.to_pylist(), len(counts)
    columns = [np.full(int(term.max()) + 1, -1, np.int64) for _ in names]
    for k, column in enumerate(columns):
        own = order[edges[k] : edges[k + 1]]
        column[term[own]] = rank[own]
    left, right, c, d, times = [], [], [], [], []
    for a in range(len(names)):
        own = np.sort(term[order[edges[a] : edges[a + 1]]])
        for b in range(a + 1, len(names)):
            other = columns[b][own]
            both = other >= 0
            key, tally = np.unique(columns[a][own][both] * width + other[both], return_counts=True)
            first, second = (a, b) if names[a] < names[b] else (b, a)
            x, y = counts[key // width], counts[key % width]
            c.append(x if first == a else y)
            d.append(y if first == a else x)
            left.append(np.full(len(key), first))
            right.append(np.full(len(key), second))
            times.append(tally)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    total = join(times)
    return pa.table(
        {
            "lang": pa.array([lang.as_py()] * len(total), pa.string()),
            "a": coded.dictionary.take(pa.array(join(left), pa.int64())).cast(pa.string()),
            "b": coded.dictionary.take(pa.array(join(right), pa.int64())).cast(pa.string()),
            "c": pa.array(join(c), pa.int64()),
            "d": pa.array(join(d), pa.int64()),
            "times": pa.array(total, pa.int64()),
        }
    )


def _weight(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * kept)), exact."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * cast({count} + {ADD} as decimal(20,0))) div cast({total} + {ADD} * {kept} as decimal(20,0))")


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Return (lang, source, term, n, docs): occurrences of each term in each group, and the documents that have it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counted = map_batches(rows, _count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def joint_histograms(counts: DataFrame, cells: int, lang_rows: int = CELLS) -> DataFrame:
    """Return (lang, a, b, c, d, times) for sources a < b that share terms; c and d are positive.

    ``counts`` are (lang, source, term, n), ``cells`` how many. A block has the terms of a
    language with one hash, so that it grows with neither terms nor documents.
    """
    blocks = max(1, -(-cells // lang_rows))
    dealt = counts.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    tallied = dealt.groupBy("lang", "block").applyInArrow(_tally, "lang string, a string, b string, c long, d long, times long")
    return tallied.groupBy("lang", "a", "b", "c", "d").agg(F.sum("times").alias("times"))


def audit(df: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Return (lang, source, part, item, value, rank): the pair and the term part of every group."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        counts = scratch.write(term_counts(df, text_col, lang_col, source_col))
        of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= documents).drop("lang_docs")
        kept = scratch.write(counts.drop("docs").join(of_lang, ["lang", "term"]))
        terms_of = scratch.write(of_lang)
        present = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
        sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
        langs = terms_of.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        groups = scratch.write(present.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "own", "v", "lang_total"]))
        joint = scratch.write(joint_histograms(kept, kept.count()))
        report = Scratch(spark).write(_pairs(kept, groups, joint).unionByName(_terms(kept, groups, ranks)))
    return report


def _pairs(kept: DataFrame, groups: DataFrame, joint: DataFrame) -> DataFrame:
    """The pair part: each group with each other source of its language."""
    side = lambda p: groups.select("lang", "v", F.col("source").alias(p), F.col("n").alias(f"n_{p}"), F.col("own").alias(f"own_{p}"))
    pairs = side("a").join(side("b").drop("v"), "lang").where("a < b")
    # Combinations without a zero, and what their terms would give if the other count were zero.
    weighed = joint.join(pairs, ["lang", "a", "b"]).withColumns({"p": _weight("c", "n_a", "v"), "q": _weight("d", "n_b", "v"), "p0": _weight("0", "n_a", "v"), "q0": _weight("0", "n_b", "v")})
    met = weighed.groupBy("lang", "a", "b").agg(
        F.sum(F.col("times") * F.abs(F.col("p") - F.col("q"))).alias("met"),
        F.sum(F.col("times") * F.abs(F.col("p") - F.col("q0"))).alias("met_a"),
        F.sum(F.col("times") * F.abs(F.col("p0") - F.col("q"))).alias("met_b"),
        F.sum("times").alias("shared"),
    )
    # Each group's own histogram against a zero in each other source.
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).withColumnRenamed("n", "c")
    both = pairs.select("lang", "v", F.col("a").alias("source"), F.col("b").alias("item"), F.col("n_a").alias("n"), F.col("n_b").alias("n_item")).union(pairs.select("lang", "v", "b", "a", "n_b", "n_a"))
    alone = own.join(both, ["lang", "source"]).withColumns({"p": _weight("c", "n", "v"), "q0": _weight("0", "n_item", "v")})
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("q0"))).alias("alone"))
    none = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.abs(_weight("0", "n_a", "v") - _weight("0", "n_b", "v")))
    value = (
        pairs.join(met, ["lang", "a", "b"], "left")
        .join(alone.select("lang", F.col("source").alias("a"), F.col("item").alias("b"), F.col("alone").alias("alone_a")), ["lang", "a", "b"], "left")
        .join(alone.select("lang", F.col("source").alias("b"), F.col("item").alias("a"), F.col("alone").alias("alone_b")), ["lang", "a", "b"], "left")
        .na.fill(0, ["met", "met_a", "met_b", "shared", "alone_a", "alone_b"])
        .select("lang", "a", "b", (F.expr("met + (alone_a - met_a) + (alone_b - met_b)") + F.expr("v - own_a - own_b + shared") * none).alias("value"))
    )
    part = value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(value.select("lang", "b", "a", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return part.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """The term part: the terms a group has in excess of its language."""
    sized = kept.join(groups.withColumnRenamed("n", "total"), ["lang", "source"])
    excess = (_weight("n", "total", "v") - _weight("lang_n", "lang_total", "v")).alias("value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = sized.select("lang", "source", F.col("term").alias("item"), excess).where("value > 0").withColumn("rank", rank).where(F.col("rank") <= ranks)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
