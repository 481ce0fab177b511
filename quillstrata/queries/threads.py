"""Thread queries: contributions made from conversations, folded and checked.

Every conversation is a thread, every turn one contribution, a pure function of
its place k in the thread: k mod 4 = 0 creates a region, 1 reinforces it, 2
extends it and turns attention down, 3 preserves it or (k mod 8 = 7) supersedes
the region before it. Relations, tensions and constraints follow cycles of 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import derived, fold
from quillstrata.sources import read_table, work_folder
from quillstrata.streaming import threads as live

_NONE = "array()"


def _text(prefix: str, shift: int = 0) -> str:
    return f"concat('{prefix}', k - {shift})" if shift else f"concat('{prefix}', k)"


def _region(shift: int = 0) -> str:
    referent = f"array(named_struct('referent_id', {_text('ref')}, 'expression', role, 'source_contribution_id', {_text('c')}))"
    empty = "cast(array() as array<string>)"
    return f"named_struct('region_id', {_text('r')}, 'anchor_referents', {referent}, 'relation_ids', {empty}, 'local_constraint_ids', {empty}, 'open_tension_ids', {empty}, 'source_contribution_ids', {empty}, 'persistence_state', 'active', 'activation_band', 'primary')"


#: JSON of each declaration list, by place in the thread.
_OPERATIONS = {
    "region_operations": f"""CASE k % 4
        WHEN 0 THEN to_json(array(named_struct('operation', 'create', 'region', {_region()})))
        WHEN 1 THEN to_json(array(named_struct('operation', 'reinforce', 'region_id', {_text('r', 1)}, 'reason', role)))
        WHEN 2 THEN to_json(array(named_struct('operation', 'extend', 'region_id', {_text('r', 2)}, 'referent', named_struct('referent_id', {_text('ref')}, 'expression', role, 'source_contribution_id', {_text('c')}))))
        ELSE CASE WHEN k % 8 = 3 THEN to_json(array(named_struct('operation', 'preserve', 'region_id', {_text('r', 3)}, 'reason', role)))
             ELSE to_json(array(named_struct('operation', 'supersede', 'region_id', {_text('r', 7)}, 'superseded_by_region_id', {_text('r', 3)}, 'reason', role))) END END""",
    "relation_operations": f"""CASE k % 8
        WHEN 5 THEN to_json(array(named_struct('operation', 'connect', 'relation', named_struct('relation_id', {_text('rel')}, 'source_region_id', {_text('r', 1)}, 'relation_type', named_struct('kind', 'continuation'), 'target_region_id', {_text('r', 5)}, 'source_contribution_id', {_text('c')}, 'lifecycle', 'active'))))
        WHEN 6 THEN to_json(array(named_struct('operation', 'disconnect', 'relation_id', {_text('rel', 1)}, 'reason', role))) ELSE '[]' END""",
    "constraint_operations": f"""CASE k % 8
        WHEN 0 THEN to_json(array(named_struct('operation', 'add', 'constraint', named_struct('constraint_id', {_text('con')}, 'expression', role, 'applicability', named_struct('kind', 'whole_problem_space'), 'source_contribution_id', {_text('c')}, 'lifecycle', 'active'))))
        WHEN 4 THEN to_json(array(named_struct('operation', 'retire', 'constraint_id', {_text('con', 4)}, 'reason', role))) ELSE '[]' END""",
    "tension_operations": f"""CASE k % 8
        WHEN 4 THEN to_json(array(named_struct('operation', 'open', 'tension', named_struct('tension_id', {_text('ten')}, 'region_id', {_text('r')}, 'tension_type', named_struct('kind', 'contradiction'), 'candidate_bindings', cast(array() as array<string>), 'source_turn_id', {_text('t')}, 'lifecycle', 'open'))))
        WHEN 6 THEN to_json(array(named_struct('operation', 'resolve', 'tension_id', {_text('ten', 2)}, 'resolution', role))) ELSE '[]' END""",
    "attention_operations": f"CASE k % 4 WHEN 2 THEN to_json(array(named_struct('region_id', {_text('r', 2)}, 'band', 'secondary'))) ELSE '[]' END",
    "preservation_declarations": "'[]'",
    "release_declarations": "'[]'",
}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with their place k in the thread."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    return read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("thread_id"), "turn", "role", "text", place.alias("k"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted log of all threads, contributions as JSON."""
    names = F.format_string('{"contribution_id":"c%d","source_turn_id":"t%d","source_utterance_id":"u%d"', "k", "k", "k")
    lists = [F.concat(F.lit(f',"{name}":'), F.expr(sql)) for name, sql in _OPERATIONS.items()]
    body: Column = F.concat(names, *lists, F.lit("}"))
    return turns(spark, sf_dir).select("thread_id", F.col("k").alias("ordinal"), (F.col("k") + 1).alias("sequence"), F.col("k").alias("prior_state_version"), "role", body.alias("contribution"), *(F.concat(F.lit(p), F.col("k")).alias(f"{n}_id") for p, n in (("c", "contribution"), ("t", "source_turn"), ("u", "source_utterance"))))


_TURNS = "SELECT conv_id::VARCHAR AS thread_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations"
_N = f"SELECT thread_id, count(*) AS n FROM ({_TURNS}) GROUP BY thread_id"
#: How many k < n have k mod m = r.
_COUNT = "((n - 1 - {r} + {m}) // {m})"


def _times(r: int, m: int) -> str:
    return _COUNT.format(r=r, m=m)


def _states(spark, sf_dir):
    return fold.replay_threads(log(spark, sf_dir))


@register("fold_state", f"""SELECT thread_id, n AS version, {_times(0, 4)} - {_times(7, 8)} AS operational_regions, {_times(7, 8)} AS superseded_regions, {_times(5, 8)} - {_times(6, 8)} AS active_relations,
  {_times(4, 8)} - {_times(6, 8)} AS open_tensions, {_times(0, 8)} - {_times(4, 8)} AS active_constraints, 't' || (n - 1)::VARCHAR AS last_turn_id FROM ({_N})""")
def fold_state(spark, sf_dir):
    """State of every thread after its last turn, in numbers."""
    schema = "version long, regions array<struct<persistence_state:string>>, relations array<struct<lifecycle:string>>, constraints array<struct<lifecycle:string>>, open_tensions array<struct<lifecycle:string>>, source_turn_range struct<last_turn_id:string>"
    state = _states(spark, sf_dir).select("thread_id", F.from_json("state", schema).alias("s"))

    def count(family: str, field: str, *values: str) -> Column:
        return F.size(F.filter(f"s.{family}", lambda x: x[field].isin(*values))).cast("long")

    return state.select(
        "thread_id",
        F.col("s.version").alias("version"),
        count("regions", "persistence_state", "active", "background", "unresolved").alias("operational_regions"),
        count("regions", "persistence_state", "superseded").alias("superseded_regions"),
        count("relations", "lifecycle", "active").alias("active_relations"),
        count("open_tensions", "lifecycle", "open").alias("open_tensions"),
        count("constraints", "lifecycle", "active").alias("active_constraints"),
        F.col("s.source_turn_range.last_turn_id").alias("last_turn_id"),
    )


@register("fold_rejections", f"""SELECT thread_id, CASE t WHEN 1 THEN 'duplicate_accepted_identity' WHEN 2 THEN 'accepted_entry_sequence_mismatch' WHEN 3 THEN 'accepted_entry_prior_version_mismatch' END AS code
  FROM (SELECT thread_id, n, thread_id::BIGINT % 5 AS t FROM ({_N})) WHERE n >= 2 AND t IN (1, 2, 3)""")
def fold_rejections(spark, sf_dir):
    """Violations of logs that were made faulty: repeated identities, wrong sequences and versions."""
    fault, last = F.col("thread_id").cast("long") % 5, F.col("ordinal") == 1
    bad = log(spark, sf_dir)
    bad = bad.withColumn("contribution", F.when((fault == 1) & last, F.replace("contribution", F.lit('"source_turn_id":"t1"'), F.lit('"source_turn_id":"t0"'))).otherwise(F.col("contribution")))
    bad = bad.withColumn("sequence", F.when((fault == 2) & last, 9).otherwise(F.col("sequence"))).withColumn("prior_state_version", F.when((fault == 3) & last, 9).otherwise(F.col("prior_state_version")))
    return fold.replay_threads(bad).where("violation is not null").select("thread_id", "violation.code")


@register("fold_bounded", f"SELECT thread_id, 'operational_regions' AS kind, 2::BIGINT AS actual, 1::BIGINT AS maximum FROM ({_N}) WHERE n >= 5")
def fold_bounded(spark, sf_dir):
    """Threads that a bound of one operational region rejects."""
    bounded = fold.replay_threads(log(spark, sf_dir), fold.Limits(100, 1, 20, 20, 20))
    return bounded.where("violation is not null").select("thread_id", "violation.kind", "violation.actual", "violation.maximum")


@register("log_validation", "SELECT conv_id::VARCHAR AS thread_id, min(k) AS position, 'accepted_entry_sequence_mismatch' AS code FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations WHERE turn <> 1) WHERE turn <> k GROUP BY conv_id")
def log_validation(spark, sf_dir):
    """First gap of each thread when the second turn is missing."""
    gapped = turns(spark, sf_dir).where("turn <> 1").select("thread_id", F.struct("turn", "role", "text").alias("ordinal"), (F.col("turn") + 1).alias("sequence"), F.col("turn").alias("prior_state_version"))
    return derived.log_faults(gapped)


@register("duplicate_identity", "SELECT conv_id::VARCHAR AS thread_id, 'source_utterance' AS kind, role AS identity, count(*) AS times FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def duplicate_identity(spark, sf_dir):
    """Utterance identities used twice, if roles were identities."""
    return derived.repeated_identities(log(spark, sf_dir).withColumn("source_utterance_id", F.col("role")))


_CATEGORIES = """CASE k % 8 WHEN 0 THEN 'create,constrain' WHEN 1 THEN 'reinforce' WHEN 2 THEN 'extend,redirect_attention' WHEN 3 THEN 'preserve' WHEN 4 THEN 'create,constrain,tension,retire' WHEN 5 THEN 'reinforce,relate' WHEN 6 THEN 'extend,relate,tension,redirect_attention,retire' ELSE 'supersede' END"""


@register("history_categories", f"SELECT thread_id, k, {_CATEGORIES} AS transformations FROM ({_TURNS})")
def history_categories(spark, sf_dir):
    """Categories of every accepted contribution."""
    schema = "contribution_history array<struct<contribution_id:string, transformations:array<string>>>"
    history = _states(spark, sf_dir).select("thread_id", F.inline(F.from_json("state", schema)["contribution_history"]))
    return history.select("thread_id", F.substring("contribution_id", 2, 20).cast("long").alias("k"), F.array_join("transformations", ",").alias("transformations"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current regions of all threads, set-wise from the log."""
    made, n = turns(spark, sf_dir), Window.partitionBy("thread_id")
    made = made.withColumn("n", F.count("*").over(n)).where("k % 4 = 0")
    state = F.when((F.col("k") % 8 == 0) & (F.col("k") + 7 < F.col("n")), "superseded").otherwise("active")
    band = F.when(F.col("k") + 2 < F.col("n"), "secondary").otherwise("primary")
    return made.select("thread_id", F.col("k").alias("ordinal"), F.concat(F.lit("r"), F.col("k")).alias("region_id"), state.alias("persistence_state"), band.alias("activation_band"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of all threads, as if none were disconnected."""
    made = turns(spark, sf_dir).where("k % 8 = 5")
    return made.select("thread_id", F.col("k").alias("ordinal"), F.concat(F.lit("rel"), F.col("k")).alias("relation_id"), F.concat(F.lit("r"), F.col("k") - 1).alias("source_region_id"), F.concat(F.lit("r"), F.col("k") - 5).alias("target_region_id"), F.lit("active").alias("lifecycle"))


_REGIONS = f"SELECT thread_id, k AS ordinal, 'r' || k::VARCHAR AS region_id, CASE WHEN k % 8 = 0 AND k + 7 < n THEN 'superseded' ELSE 'active' END AS state, CASE WHEN k + 2 < n THEN 'secondary' ELSE 'primary' END AS band FROM ({_TURNS}) JOIN ({_N}) USING (thread_id) WHERE k % 4 = 0"
_ENDS = f"SELECT thread_id, k AS ordinal, 'rel' || k::VARCHAR AS relation_id, unnest(['r' || (k - 1)::VARCHAR, 'r' || (k - 5)::VARCHAR]) AS region_id FROM ({_TURNS}) WHERE k % 8 = 5"


@register("attention_lens", f"SELECT thread_id, band AS activation_band, string_agg(region_id, ',' ORDER BY ordinal) AS region_ids FROM ({_REGIONS}) WHERE state = 'active' GROUP BY ALL")
def attention_lens(spark, sf_dir):
    """Operational regions by band, from the regions table."""
    return derived.attention_lens(regions(spark, sf_dir))


@register("attention_lens_folded", f"SELECT thread_id, band AS activation_band, string_agg(region_id, ',' ORDER BY ordinal) AS region_ids FROM ({_REGIONS}) WHERE state = 'active' GROUP BY ALL")
def attention_lens_folded(spark, sf_dir):
    """The same lens from folded states: both ways must agree."""
    schema = "attention_lens struct<primary_region_ids:array<string>, secondary_region_ids:array<string>, tertiary_region_ids:array<string>, background_region_ids:array<string>>"
    lens = _states(spark, sf_dir).select("thread_id", F.from_json("state", schema)["attention_lens"].alias("l"))
    bands = F.array(*(F.struct(F.lit(b).alias("activation_band"), F.array_join(F.col(f"l.{b}_region_ids"), ",").alias("region_ids")) for b in fold.BANDS))
    return lens.select("thread_id", F.inline(bands)).where("region_ids <> ''")


@register("incidence_rebuild", f"SELECT e.thread_id, e.region_id, string_agg(relation_id, ',' ORDER BY e.ordinal) AS relation_ids FROM ({_ENDS}) e JOIN ({_REGIONS}) r ON e.thread_id = r.thread_id AND e.region_id = r.region_id AND r.state = 'active' GROUP BY ALL")
def incidence_rebuild(spark, sf_dir):
    """Relations of operational regions, in order."""
    return derived.incidence(regions(spark, sf_dir), relations(spark, sf_dir))


@register("closure_violations", f"SELECT e.thread_id, e.relation_id, e.region_id, CASE WHEN r.state IS NULL THEN 'endpoint missing' ELSE 'active relation endpoint' END AS fault FROM ({_ENDS}) e LEFT JOIN ({_REGIONS}) r ON e.thread_id = r.thread_id AND e.region_id = r.region_id WHERE r.state IS NULL OR r.state <> 'active'")
def closure_violations(spark, sf_dir):
    """Active relations whose endpoint is superseded."""
    return derived.open_ends(regions(spark, sf_dir), relations(spark, sf_dir))


@register("bound_violations", f"SELECT thread_id, 'operational_regions' AS kind, count(*) AS actual, 1::BIGINT AS maximum FROM ({_REGIONS}) WHERE state = 'active' GROUP BY thread_id HAVING count(*) > 1")
def bound_violations(spark, sf_dir):
    """Threads with more than one operational regions."""
    counts = regions(spark, sf_dir).where("persistence_state = 'active'").groupBy("thread_id").agg(F.count("*").alias("operational_regions"))
    return derived.excess(counts, {"operational_regions": 1})


@register("continuity", f"SELECT thread_id, k, lag(text) OVER (PARTITION BY thread_id ORDER BY k) AS previous_text FROM ({_TURNS})")
def continuity(spark, sf_dir):
    """The preceding turn of every turn; none on a fresh thread."""
    before = F.lag("text").over(Window.partitionBy("thread_id").orderBy("k"))
    return turns(spark, sf_dir).select("thread_id", "k", before.alias("previous_text"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of live threads to turns that arrive in three deliveries, the last with old turns once more.

    The stream ends after the first delivery and starts again from its checkpoint.
    """
    session = spark.newSession()
    live.use_rocksdb(session)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    folder = work_folder(spark)
    entries = log(spark, sf_dir).select("thread_id", "sequence", "contribution")
    deliveries = (entries.where("sequence <= 3"), entries.where("sequence between 4 and 6"), entries.where("sequence > 6 or sequence = 2"))
    for number, delivery in enumerate(deliveries):
        delivery.write.mode("append").parquet(f"{folder}/inbox")
        if number != 1:
            live.run_available(session.readStream.schema(entries.schema).parquet(f"{folder}/inbox"), folder)
    return spark.read.parquet(f"{folder}/answers")


_LIVED = f"""SELECT thread_id, k, n FROM ({_TURNS}) JOIN ({_N}) USING (thread_id)"""


@register("live_lifecycles", f"""WITH v AS ({_LIVED}) SELECT thread_id, 'region' AS family, 'r' || k::VARCHAR AS id, CASE WHEN k % 8 = 0 AND k + 7 < n THEN 'superseded' ELSE 'active' END AS lifecycle FROM v WHERE k % 4 = 0
  UNION ALL SELECT thread_id, 'relation', 'rel' || k::VARCHAR, CASE WHEN k + 1 < n THEN 'retired' ELSE 'active' END FROM v WHERE k % 8 = 5
  UNION ALL SELECT thread_id, 'constraint', 'con' || k::VARCHAR, CASE WHEN k + 4 < n THEN 'retired' ELSE 'active' END FROM v WHERE k % 8 = 0
  UNION ALL SELECT thread_id, 'tension', 'ten' || k::VARCHAR, CASE WHEN k + 2 < n THEN 'resolved' ELSE 'open' END FROM v WHERE k % 8 = 4""")
def live_lifecycles(spark, sf_dir):
    """What every record of every live thread has become, after a restart of the stream."""
    return live.lifecycles(_answered(spark, sf_dir))


@register("live_answers", f"""WITH v AS ({_LIVED}) SELECT thread_id, k + 1 AS sequence, true AS accepted, k + 1 AS version, NULL AS code FROM v
  UNION ALL SELECT thread_id, 2, false, least(n, 3), 'accepted_entry_sequence_mismatch' FROM v WHERE k = 1""")
def live_answers(spark, sf_dir):
    """The answer to every arrival; turns that arrive again are told so and change nothing."""
    return _answered(spark, sf_dir).select("thread_id", "sequence", "accepted", "version", "code")
