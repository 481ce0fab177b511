"""Sharding, the divergence audit and vector codes against brute force and odd rows."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrata.llm import divergence, registry, sharding, vector_codes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, item long, size long, shard int, level int, part long, bin long, term string, n long, docs long, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[-1] * 6, "x", -1, -1, -1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, empty and very long texts, ties, repeated rows and odd characters."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("abcDEé漢", k=rng.randint(1, 4))) for _ in range(n))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (None, "one Two", "en", None), (None, None, None, None), (5, text(40_000), "en", "b"), (6, "É é ß 漢字 \U0001f600 a1b2-c", None, "a")]
    rows += [(7, "same words here", "de", "a")] * 40
    rows += [(100 + i, text(rng.randint(0, 30)), rng.choice(["en", "de", "xx"]), rng.choice(["a", "b", "c", ""])) for i in range(400)]
    return rows


# Sharding


def heap_schedule(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(((s, k) for k, s in sizes.items()), key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def check_shards(got, rows, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, homes, loads = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())
    groups = collections.Counter()
    for _, t, *_ in rows:
        groups[t or ""] += size(t)
    return loads, groups


@pytest.mark.parametrize("part_items", [10_000, 60])
def test_shards_keep_equal_texts_and_near_equal_sizes(spark, odd, part_items):
    got = sharding.shard_documents(frame(spark, odd).repartition(5), 7, part_items=part_items).collect()
    loads, groups = check_shards(got, odd, 7)
    mean = sum(loads.values()) / 7
    assert max(loads.values()) <= max(mean + max(v for v in groups.values() if v < mean), max(groups.values()))


def test_one_part_is_the_textbook_schedule(spark, odd):
    got = sharding.shard_documents(frame(spark, odd), 5).collect()
    loads, groups = check_shards(got, odd, 5)
    expected = collections.Counter()
    for text, shard in heap_schedule(groups, 5).items():
        expected[shard] += groups[text]
    assert sorted(loads.values()) == sorted(expected.values())


def test_levels_even_out_what_parts_leave(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 900) + str(i), "en", "a") for i in range(4000)]
    loads, _ = check_shards(sharding.shard_documents(frame(spark, rows), 4, part_items=150).collect(), rows, 4)
    assert max(loads.values()) - min(loads.values()) < 0.005 * sum(loads.values()) / 4


def test_a_group_of_a_third_of_all_rows_has_a_shard_to_itself(spark):
    rows = [(i, "copied text of some length", "en", "a") for i in range(3000)] + [(9000 + i, f"text {i}", "en", "a") for i in range(3000)]
    loads, groups = check_shards(sharding.shard_documents(frame(spark, rows).repartition(8), 6, part_items=500).collect(), rows, 6)
    assert max(loads.values()) == max(groups.values())
    rest = sorted(loads.values())[:-1]
    assert rest[-1] - rest[0] <= 64


def test_shards_of_nothing_and_of_other_ids(spark):
    assert sharding.shard_documents(frame(spark, []), 40).collect() == []
    with pytest.raises(TypeError):
        sharding.shard_documents(frame(spark, []).withColumn("doc_id", F.lit("a")), 40)


def test_written_shards_hold_all_columns(spark, odd, tmp_path):
    docs = frame(spark, odd).select("doc_id", "text", "lang")
    sharding.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert collections.Counter(map(tuple, back.select("doc_id", "text", "lang").collect())) == collections.Counter(r[:3] for r in odd)
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


# Divergence audit


def brute_audit(rows, documents, ranks):
    docs, n, group_n, groups = collections.Counter(), collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        for t in found:
            n[lang, t] += 1
            group_n[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang, source in groups:
        kept = [t for (x, t), d in docs.items() if x == lang and d >= documents]

        def weights(count, kept=kept):
            total = sum(map(count, kept))
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept}

        own, whole = weights(lambda t, g=(lang, source): group_n[*g, t]), weights(lambda t, x=lang: n[x, t])
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            q = weights(lambda t, g=(lang, other): group_n[*g, t])
            pairs.append((-sum(abs(own[t] - q[t]) for t in kept), other.encode()))
        terms = [(whole[t] - own[t], t.encode()) for t in kept if group_n[lang, source, t] and own[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("documents", "cells"), [(3, 200_000), (30, 50), (10_000, 50)])
def test_audit_equals_brute_force(spark, odd, documents, cells, monkeypatch):
    whole = divergence.joint_histograms
    monkeypatch.setattr(divergence, "joint_histograms", lambda counts, n: whole(counts, n, cells))
    got = divergence.audit(frame(spark, odd).repartition(3), documents, 4).collect()
    assert sorted(map(tuple, got)) == brute_audit(odd, documents, 4)


def test_joint_histograms_tally_the_cells_that_two_sources_share(spark):
    counts = spark.createDataFrame([("en", "b", "x", 2), ("en", "a", "x", 1), ("en", "a", "y", 1), ("en", "b", "y", 2), ("en", "a", "z", 9), ("de", "a", "x", 4)], "lang string, source string, term string, n long")
    got = divergence.joint_histograms(counts, 6, 2).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "b", 1, 2, 2)]


def test_terms_do_not_cross_documents(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(["ab", "cd", "", "e"])]
    got = divergence.term_counts(frame(spark, rows).coalesce(1)).collect()
    assert sorted((r.term, r.n, r.docs) for r in got) == [("ab", 1, 1), ("cd", 1, 1), ("e", 1, 1)]


def test_counts_beyond_what_doubles_hold_stay_exact(spark):
    big = 9_007_199_254_740_993
    got = spark.range(1).select(divergence._weight(f"{big}L", f"{3 * big}L", "7L").alias("w")).first().w
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 35)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


# Vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, rows long, ids long, part long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, -1, -1, -1) for r in rows], VECTORS)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(Fraction(float(x)) * 1024) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in cut:
                members[near(v[p], books[p])[1]].append(v[p])
            for k, own in members.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(e for e, _ in f) for f in found]
    labels = collections.Counter()
    for (_, _, y), e in zip(kept, errors, strict=True):
        labels[y] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{k:02x}" for _, k in f), e, labels[y], digest) for (i, _, y), f, e in zip(kept, found, errors, strict=True))


def odd_vectors(rng, n, size):
    number = lambda: float(np.float32(rng.gauss(0, 0.3)))
    rows = [(i * 3, [number() for _ in range(size)], rng.choice([1, 2, 3, None])) for i in range(n)]
    rows += [rows[5]] * 30 + [(1, rows[2][1], None), (2, None, 1), (4, [None] * size, 1), (7, [float("nan")] + [0.0] * (size - 1), 2), (8, [float("inf")] * size, 2), (None, rows[1][1], 1), (None, rows[0][1], None)]
    rows += [(3 * n + i, rows[9][1], 2) for i in range(50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "entries", "block"), [(300, 256, 8192), (300, 16, 37), (20, 256, 8)])
def test_codes_equal_brute_force(spark, monkeypatch, n, entries, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = odd_vectors(random.Random(n + entries), n, 8)
    got = vector_codes.compress(vectors(spark, rows).repartition(3), 4, entries, 3).collect()
    assert collections.Counter(map(tuple, got)) == brute_codes(rows, 4, entries, 3)


@pytest.mark.parametrize("scale", [3e5, 1e13])
def test_components_of_any_width_are_exact(spark, scale):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(4)], 1) for i in range(60)]
    if scale > 1e12:  # parts that equal their entry have no error, however long
        rows = [(i, v, y) for i, v, y in rows for _ in range(2)]
    entries = 256 if scale > 1e12 else 9
    got = vector_codes.compress(vectors(spark, rows), 4, entries, 2).collect()
    assert collections.Counter(map(tuple, got)) == brute_codes(rows, 4, entries, 2)


def test_codes_of_nothing_and_of_vectors_without_components(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []
    got = vector_codes.compress(vectors(spark, [(1, [], 1), (2, [], None)])).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


@pytest.mark.parametrize("lengths", [(4, 8), (6, 6)])
def test_vectors_that_cannot_be_cut_alike_are_named(spark, lengths):
    rows = [(i, [0.5] * n, 1) for i, n in enumerate(lengths)]
    with pytest.raises(Exception, match="components|parts"):
        vector_codes.compress(vectors(spark, rows)).collect()


def test_decoded_vectors_are_the_entries(spark):
    rows = odd_vectors(random.Random(2), 100, 8)
    df = vectors(spark, rows)
    packed = vector_codes.blocks(df, 4, "vec_id", "embedding", "label")
    books = vector_codes.train(packed, vector_codes.start_books(df, 4, 16, "vec_id", "embedding"), 2, 200)
    for r in vector_codes.decode(vector_codes.encode(packed, books), books).collect():
        code = bytes.fromhex(r.code)
        assert r.vector == [x / 1024 for p in range(4) for x in books[p][code[p]].tolist()]


def test_registered_queries_give_the_agreed_columns(spark):
    where = "/root/testdata/sf0.001"
    found = registry.queries()
    assert found["op11_sharding"](spark, where).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert found["op12_source_divergence"](spark, where).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert found["op13_vector_codes"](spark, where).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
