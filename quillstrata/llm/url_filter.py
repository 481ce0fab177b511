"""URL allow and block rules, with DataFrame functions only.

A rule is a host and a path. It fits the urls of its host and of all subdomains
whose path starts with the rule's path. Each distinct url is expanded into
host-suffix and path-prefix expressions (only with as many labels and characters
as some rule has), joined to the rules on a short prefix of the expression's
digest, and confirmed on the full digest. The longest rule wins; of equally long
ones the one with the longer host, then a blocking one.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged by no rule; repeated rows and repeated or null ids are judged each;
other columns are ignored; an empty table gives no rows. A url that no rule fits
is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to every executor (about 200 bytes each); more are shuffled.
BROADCAST_RULES = 50_000
#: Hexadecimal digits of a digest that the join compares.
PREFIX = 8
#: Tasks that share the rows of one host.
SALTS = 16
#: What becomes of a url that no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return (page_id, host, path, rule, verdict), one row an input row.

    ``rules`` are (host, path, verdict), a short list or a table of any size; a rule is
    named by its host and path.
    """
    spark = df.sparkSession
    urls = df.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not isinstance(rules, DataFrame):
        fields = ("host", "path", "verdict")
        literals = F.array(*(F.struct(*(F.lit(x).alias(f) for x, f in zip(rule, fields, strict=True))) for rule in rules or [("", "", "")]))
        rules = spark.range(1).select(F.inline(literals)).where(F.lit(bool(rules)))
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    # The numbers of labels and the lengths of paths that rules have, not the rules, come to the driver.
    shapes = listed.groupBy(F.size(F.split("rule_host", r"\.")).alias("labels"), F.char_length("rule_path").alias("depth")).count().collect()
    labels, depths, count = sorted({r["labels"] for r in shapes}), sorted({r["depth"] for r in shapes}), sum(r["count"] for r in shapes)
    full = _digest(F.col("rule_host"), F.col("rule_path"))
    listed = listed.select("*", full.alias("full"), F.substring(full, 1, PREFIX).alias("short"))

    # Paths that agree in all the characters a rule can look at are judged once.
    reach = max(depths, default=0)
    asked = urls.where(F.col("host") != "").select("host", F.substring("path", 1, reach).alias("head")).distinct()
    suffixes = F.array(*(F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in labels)) if labels else F.array().cast("array<string>")
    prefixes = F.array(*(F.when(F.char_length("head") >= n, F.substring("head", 1, n)) for n in depths)) if depths else F.array().cast("array<string>")
    expanded = asked.select("host", "head", F.explode(F.array_compact(suffixes)).alias("suffix"))
    expanded = expanded.select("host", "head", "suffix", F.explode(F.array_compact(prefixes)).alias("prefix"))
    digest = _digest(F.col("suffix"), F.col("prefix"))
    expanded = expanded.select("host", "head", digest.alias("asked"), F.substring(digest, 1, PREFIX).alias("short"))

    fits = expanded.join(F.broadcast(listed) if count <= BROADCAST_RULES else listed, "short").where("asked = full")
    rank = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.char_length("rule_host").alias("h"), F.col("rule_verdict").alias("v"))
    best = fits.groupBy("host", "head").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    # The rows of one host and head are dealt over ``SALTS`` tasks.
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = urls.withColumn("head", F.substring("path", 1, reach)).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    judged = dealt.join(salted, ["host", "head", "salt"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
