"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.llm import audio, decontaminate, divergence, language, lm_score, near_duplicates, packing, quality, secret_scan, sharding, toxicity, url_filter, vector_codes
from quillstrata.llm.samples import crc32_fold
from quillstrata.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]

# The url rules of the contract, (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql:
            _SQL[query.__name__] = sql
        return query

    return add


@_query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every text against all others."""
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


@_query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three folds of four."""
    documents = read_table(spark, sf_dir, "documents")
    model = language.train(documents.where(crc32_fold(F.col("doc_id"), 4) != 2))
    return language.predict(documents, model, held_out="crc32(cast(id as string)) % 4 = 2")


@_query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four folds of five."""
    documents, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train(documents, labels.where(crc32_fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(documents, model, held_out="crc32(cast(doc_id as string)) % 5 = 0")


@_query()
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over three-word shingles at 85 in 100."""
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"), 3, 85, 100)


@_query()
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as A-law sound, stored as resampled PCM, read back and described."""
    return audio.media_features(audio.store(read_table(spark, sf_dir, "documents")))


@_query()
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text and of all layers encoded in it."""
    return secret_scan.summarise(secret_scan.scan_secrets(read_table(spark, sf_dir, "documents")))


@_query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from four folds of five."""
    documents, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = quality.train(documents, labels.where(crc32_fold(F.col("doc_id"), 5) != 0))
    return quality.score(documents, model, 0.3, held_out="crc32(cast(doc_id as string)) % 5 = 0")


@_query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed in sequences of 1024 tokens."""
    return packing.pack(packing.tokenize(read_table(spark, sf_dir, "documents")))


@_query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window of each."""
    return decontaminate.contaminated(*(read_table(spark, sf_dir, t) for t in ("documents", "benchmark")))


@_query(
    r"""
    WITH u AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    r(rule_host, rule_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
    SELECT page_id, host, path,
           (SELECT arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) FROM r
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
           coalesce((SELECT arg_max(v, length(rule_host) + length(rule_path)) FROM r
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
    FROM u
    """
)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


@_query()
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal sizes, equal texts together."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 40)


@_query(
    r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (
      SELECT id, lang, source,
             translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    l AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM k),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
    z AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    w AS (
      SELECT lang, source, term, n,
             1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
      FROM z),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    e AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT w.lang, w.source, 'term', w.term, (w.p - l.q)::BIGINT FROM w JOIN l ON w.lang = l.lang AND w.term = l.term WHERE w.n > 0 AND w.p > l.q),
    r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM e)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
    """
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of a language differs from the others, and by which terms."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@_query()
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as four bytes each, with the codebooks' digest and errors."""
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """Return the operators' queries."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Return the operators' SQL, where SQL can express them."""
    return dict(_SQL)
