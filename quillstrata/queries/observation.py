"""Observation of raw files: customers as files, some without a sound identity, and what a later state of them releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import observation as O
from quillstrata.queries.vault import _id, _uuid
from quillstrata.sources import durable_table, read_table, spread


def files(spark: SparkSession, sf_dir: str, mended: bool = False) -> DataFrame:
    """One file a customer: every seventh has no identity, others a malformed or a shared one, or front matter without an end.

    ``mended`` files have identities where there were none, and no shared ones.
    """
    customer, nation = (read_table(spark, sf_dir, t) for t in ("customer", "nation"))
    rows = spread(customer, "c_custkey").join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    key = F.col("c_custkey")
    shared = F.when(key % 11 == 0, key - 1).otherwise(key) if not mended else key
    identity = F.when(key % 13 == 0, F.lit("uuid: not-an-identity")).when(~((key % 7 == 0) & F.lit(not mended)), F.concat(F.lit("uuid: "), _uuid(F.concat(F.lit("file:"), shared.cast("string")))))
    lines = [
        F.lit("---"),
        identity,
        F.lit("class: customer\ntags:"),
        F.when(key % 17 != 0, F.lit("---")),
        F.lit("# Profile\n"),
        F.concat(F.lit("In [["), "n_name", F.lit("|home]], next [[file "), (key + 1).cast("string"), F.lit("#Profile]] and [[file "), key.cast("string"), F.lit("#^b]].")),
        F.when(key % 5 == 0, F.lit("\n<div> ![[picture]]")),
    ]
    name = F.concat(F.lit("file "), key.cast("string"), F.lit(".md"))
    return rows.select(F.concat(F.lit("raw/"), name).alias("path"), name.alias("filename"), F.concat_ws("\n", *lines).alias("text"))


_C = "SELECT c_custkey AS k, (SELECT max(c_custkey) FROM customer) AS last, c_custkey % 17 = 0 AS open, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 7 = 0 AND c_custkey % 13 <> 0 THEN 'missing' WHEN c_custkey % 13 = 0 THEN 'malformed' WHEN c_custkey % 11 = 0 AND twin OR (c_custkey + 1) % 11 = 0 AND next THEN 'shared' ELSE 'alone' END AS identity FROM (SELECT c_custkey, EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey - 1 AND d.c_custkey % 17 <> 0 AND d.c_custkey % 13 <> 0 AND d.c_custkey % 7 <> 0) AS twin, EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey + 1 AND d.c_custkey % 17 <> 0 AND d.c_custkey % 13 <> 0 AND d.c_custkey % 7 <> 0) AS next FROM customer c)"
#: Kinds of facts: (kind, facts of a file, class of each in a file whose identity is admitted).
_FACTS = [
    ("frontmatter_key", "CASE WHEN open THEN 0 WHEN identity = 'missing' THEN 2 ELSE 3 END", "admitted"),
    ("frontmatter_provenance", "CASE WHEN open THEN 0 WHEN identity = 'missing' THEN 2 ELSE 3 END", "admitted"),
    ("frontmatter_shape", "CASE WHEN open THEN 0 WHEN identity = 'missing' THEN 1 ELSE 2 END", "admitted"),
    ("frontmatter_shape", "CASE WHEN open THEN 0 ELSE 1 END", "open_authoring_decision"),
    ("heading", "1", "admitted"),
    ("block_candidate", "1 + (k % 5 = 0)::INT + open::INT", "admitted"),
    ("source_span", "1 + (k % 5 = 0)::INT + open::INT", "admitted"),
    ("raw_markdown", "1", "admitted"),
    ("wikilink", "1 + (k < last)::INT", "admitted"),
    ("wikilink", "1 + (k = last)::INT + (k % 5 = 0)::INT", "unresolved"),
    ("unresolved_target", "1 + (k = last)::INT + (k % 5 = 0)::INT", "unresolved"),
    ("alias", "1", "admitted"),
    ("embed", "(k % 5 = 0)::INT", "admitted"),
    ("heading_target", "1", "admitted"),
    ("block_target", "1", "admitted"),
]
_EACH = " UNION ALL ".join(f"SELECT k, identity, open, '{kind}' AS fact_kind, '{found}' AS class, {n} AS n FROM c" for kind, n, found in _FACTS)
_IDENTITY = "SELECT 'source_identity' AS fact_kind, CASE identity WHEN 'alone' THEN 'admitted' WHEN 'shared' THEN 'quarantined' WHEN 'malformed' THEN 'rejected' ELSE 'unresolved' END AS class, 1 AS n FROM c"
_PLAIN = " UNION ALL ".join(f"SELECT '{kind}', '{found}', {n} FROM c" for kind, found, n in (("source_path", "admitted", "1"), ("source_hash", "admitted", "1"), ("corpus_snapshot", "admitted", "1"), ("parse_failure", "rejected", "open::INT"), ("unsupported_syntax", "open_authoring_decision", "(k % 5 = 0)::INT")))


def _admitted(spark: SparkSession, sf_dir: str, mended: bool = False) -> DataFrame:
    return O.admit(O.observe(files(spark, sf_dir, mended), "first", durable_table))


@register("observation_classes", f"WITH c AS ({_C}), e AS ({_EACH}) SELECT fact_kind, class, sum(n)::BIGINT AS facts FROM (SELECT fact_kind, CASE WHEN identity = 'alone' THEN class ELSE 'quarantined' END AS class, n FROM e UNION ALL {_IDENTITY} UNION ALL {_PLAIN}) GROUP BY ALL HAVING sum(n) > 0")
def observation_classes(spark, sf_dir):
    """Raw facts by kind and class of admission."""
    return _admitted(spark, sf_dir).groupBy("fact_kind", "class").agg(F.count("*").alias("facts"))


@register("observation_released", f"""WITH c AS ({_C}), e AS ({_EACH}) SELECT fact_kind, rule, outcome, sum(n)::BIGINT AS facts FROM (
  SELECT fact_kind, 'file_without_identity' AS rule, CASE WHEN open OR identity = 'malformed' THEN 'quarantined' ELSE class END AS outcome, n FROM e WHERE identity <> 'alone'
  UNION ALL SELECT 'source_identity', 'identity_shared', 'admitted', 1 FROM c WHERE identity = 'shared') GROUP BY ALL HAVING sum(n) > 0""")
def observation_released(spark, sf_dir):
    """Where facts in quarantine go when files get the identities that they lacked."""
    released = O.release(_admitted(spark, sf_dir), _admitted(spark, sf_dir, mended=True))
    return released.groupBy("fact_kind", "rule", "outcome").agg(F.count("*").alias("facts"))


@register("observation_retained", f"""WITH c AS ({_C}) SELECT 'raw/file ' || k::VARCHAR || '.md' AS path, CASE WHEN identity = 'malformed' THEN 'not-an-identity' ELSE {_id("'file:' || (CASE WHEN k % 11 = 0 THEN k - 1 ELSE k END)::VARCHAR")} END AS written,
  CASE identity WHEN 'alone' THEN 'identity_valid_and_alone' WHEN 'shared' THEN 'identity_shared' ELSE 'identity_malformed' END AS rule, 'identity' AS authority FROM c WHERE identity <> 'missing'""")
def observation_retained(spark, sf_dir):
    """Written identities as they were, with the rule that judged each and its authority."""
    rows = _admitted(spark, sf_dir).where("fact_kind = 'source_identity' and rule <> 'identity_missing'")
    return rows.select("path", F.variant_get("fact", "$.written", "string").alias("written"), "rule", "authority")
