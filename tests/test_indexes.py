"""Searches by persisted indexes against searches of the whole corpus."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import indexes as I
from quillstrata.operators import surfaces as R
from quillstrata.sources import Scratch
from quillstrata.sources.buckets import Buckets

WORDS = [f"{a}{b}" for a in ("sea", "sky", "oak", "é", "\U0001f600", "x") for b in ("", "ing", "er", "est", "\n")]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, 40))) for _ in range(300)]
    texts += [" ".join(rng.choices(WORDS, k=3)) for _ in range(600)]
    rows = [(n, t) for n, t in enumerate([*texts, None, "", "xy", texts[3], texts[3]])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def probes(spark, corpus):
    texts = [r.text for r in corpus.where("doc_id in (3, 20, 50, 70)").collect()]
    rng = random.Random(7)
    parts = [t[i : i + rng.randint(3, 25)] for t in texts for i in (0, 5, 11)] + ["nowhere at all", "xy", "x", "", "seaing oak", None, "\U0001f600er"]
    return spark.createDataFrame(list(enumerate(parts)), "item_id long, literal string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_literals_by_triples_equal_a_whole_search(spark, corpus, probes, tmp_path):
    store = Buckets(spark, str(tmp_path), I.KEYS, 8)
    I.literal_index(store, corpus, "doc_id", "text")
    found, opened = I.literal(store, probes, "item_id", "literal", Scratch(spark))
    expected = R.exact(corpus, probes, "doc_id", "item_id", "text", "literal")
    assert rows(found.select("item_id", "record_id")) == rows(expected.select("item_id", "doc_id"))
    matches = {r.item_id: r["count"] for r in expected.groupBy("item_id").count().collect()}
    costs = {r.item_id: r.opened for r in opened.collect()}
    assert 12 not in costs and 12 not in matches
    asked = [k for k in costs if k in matches]
    assert asked and sum(costs[k] for k in asked) <= 3 * sum(matches[k] for k in asked)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_ranks_by_postings_equal_a_whole_search(spark, corpus, probes, tmp_path, k, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "RICHEST", 5)
    store = Buckets(spark, str(tmp_path), I.KEYS, 8)
    I.term_index(store, corpus, "doc_id", "text")
    asked = probes.where("literal is not null").select("item_id", R.terms(F.col("literal")).alias("terms"))
    best, cost = I.ranked(store, asked, "item_id", k, Scratch(spark))
    expected = R.best_terms(corpus, asked, "doc_id", "item_id", "text", k)
    assert rows(best.select("item_id", "record_id", "matched", "position")) == rows(expected.select("item_id", "doc_id", "matched", "position"))
    assert all(r.read <= r.asked for r in cost.where("read is not null").collect())


def test_frequent_terms_are_not_read(spark, tmp_path):
    """A probe with one rare and many frequent terms reads the rare ones' postings."""
    rows_ = [(n, "common usual plain " + ("rare" if n < 5 else "other" if n % 2 else "more")) for n in range(2000)]
    store = Buckets(spark, str(tmp_path), I.KEYS, 8)
    I.term_index(store, spark.createDataFrame(rows_, "doc_id long, text string"), "doc_id", "text")
    probe = spark.createDataFrame([(1, ["common", "usual", "plain", "rare"])], "item_id long, terms array<string>")
    best, cost = I.ranked(store, probe, "item_id", 3, Scratch(spark))
    assert [(r.record_id, r.matched) for r in best.orderBy("position").collect()] == [(0, 4), (1, 4), (2, 4)]
    spent = cost.first()
    assert spent.asked == 6005 and spent.read <= 4005


def test_lists_of_a_batch_hold_every_record_once(spark, monkeypatch):
    """A batch makes one list of a unit, not a row for each record, and cuts long ones."""
    monkeypatch.setattr(I, "LIST", 3)
    held = {k: [u for n, u in enumerate(("abc", "bcd", "é😀x")) if k % (n + 1) == 0] for k in range(10)} | {10: [], 11: None}
    rows = spark.createDataFrame(list(held.items()), "record_id long, units array<string>").coalesce(1)
    lists = [tuple(r) for r in I._lists(rows).collect()]
    assert sorted((u, k) for u, ids in lists for k in ids) == sorted((u, k) for k, units in held.items() for u in units or ())
    assert max(len(ids) for _, ids in lists) == 3 and len(lists) == 4 + 2 + 2
    assert I._lists(rows.where("record_id >= 10")).count() == 0
