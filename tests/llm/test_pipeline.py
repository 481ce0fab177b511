"""The pipeline, stage by stage, against what brute force expects."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from pyspark.sql import functions as F

from test_operators import SECRET, brute_components, sentence

INSULTS = ("idiot", "scum", "trash", "clown")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, sentence(rng, 30)) for k in range(5)]
    rows, toxic, leaks = [], [], set()
    for n in range(240):
        words = sentence(rng, 60).split()
        if n % 4 == 0:
            for at in rng.sample(range(60), 4):
                words[at] = rng.choice(INSULTS)
        toxic.append((n, 1, int(n % 4 == 0)))
        rows.append((n, " ".join(words)))
    for n in range(240, 260):
        rows.append((n, rows[1][1] + f" tail{n}"))
    for n in range(260, 270):
        rows.append((n, f"{sentence(rng, 20)} {items[n % 5][1]} {sentence(rng, 20)}"))
        leaks.add(n)
    rows += [(270, f"{sentence(rng, 30)} {SECRET} {sentence(rng, 30)}"), (271, None), (272, ""), (None, sentence(rng, 20)), (273, sentence(rng, 3000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    out, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, current, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = current.collect()
        if name != "packing":
            assert current.columns == docs.columns
    clean = [(i, t) for i, t in rows if not (i is not None and i < 240 and i % 4 == 0)]
    assert collections.Counter(r.doc_id for r in out["toxicity"]) == collections.Counter(i for i, _ in clean)
    top = brute_components(clean, 5, 80, 100)
    kept = [i for i, _ in clean if i is None or top[i] == i]
    assert collections.Counter(r.doc_id for r in out["near_dedup"]) == collections.Counter(kept)
    left = [i for i in kept if i not in leaks]
    assert collections.Counter(r.doc_id for r in out["decontamination"]) == collections.Counter(left)
    texts = {r.doc_id: r for r in out["secret_scan"]}
    assert len(out["secret_scan"]) == len(left)
    assert "hunter2" not in texts[270].text and "[SECRET]" in texts[270].text
    assert all(r.n_chars == len(r.text) for r in out["secret_scan"] if r.text is not None)
    assert {r.doc_id for r in out["packing"]} == set(left)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert collections.Counter(map(tuple, whole.select(*key).collect())) == collections.Counter(tuple(r[k] for k in key) for r in out["packing"])


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
