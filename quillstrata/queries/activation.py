"""Activation queries: seeds, probes, previews, hubs, pages and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import activation as A
from quillstrata.operators import traversal as T
from quillstrata.queries.retrieval import HUB, PAGE, PREVIEW
from quillstrata.sources import Scratch, read_table

_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@register("text_preview", f"SELECT doc_id, 'available' AS state, substring(t, 1, {PREVIEW}) AS text, length(t) > {PREVIEW} AS truncated FROM (SELECT doc_id, {_NORMAL} AS t FROM documents)")
def text_preview(spark, sf_dir):
    """First characters of documents."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return read_table(spark, sf_dir, "documents").select("doc_id", A.preview(text, PREVIEW).alias("p")).select("doc_id", "p.*")


@register("label_distribution", "SELECT event_type AS label, count(*) AS records FROM events GROUP BY event_type")
def label_distribution(spark, sf_dir):
    """Events by type."""
    return A.labels(read_table(spark, sf_dir, "events"), "event_type")


def _edges(spark, sf_dir):
    return T.edges(read_table(spark, sf_dir, "lineitem"), "part", "l_partkey", "part_occurrence", "order", "l_orderkey", "incoming", "l_linenumber")


_DEGREE = "SELECT p_partkey::VARCHAR AS source_id, coalesce(n, 0) AS degree FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"


def _degrees(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_id"))
    return A.degrees(parts, _edges(spark, sf_dir), "source_id")


@register("hub_degree", f"SELECT * FROM ({_DEGREE}) WHERE degree >= {HUB}")
def hub_degree(spark, sf_dir):
    """Parts with many distinct edges."""
    return _degrees(spark, sf_dir).where(F.col("degree") >= HUB)


@register("counts", _DEGREE)
def counts(spark, sf_dir):
    """Degrees of all parts, zero included."""
    return _degrees(spark, sf_dir)


_PAIRS = f"SELECT DISTINCT l_partkey::VARCHAR AS source_id, l_orderkey AS target FROM lineitem WHERE l_partkey::VARCHAR IN (SELECT source_id FROM ({_DEGREE}) WHERE degree >= {HUB})"


def _page_sql(offset: int, pairs: str = _PAIRS) -> str:
    end = offset + PAGE
    return f"SELECT source_id, target, position, greatest(total - {end}, 0) AS remaining, CASE WHEN total > {end} THEN {end}::BIGINT END AS next_offset FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY target) - 1 AS position, count(*) OVER (PARTITION BY source_id) AS total FROM ({pairs})) WHERE position >= {offset} AND position < {end}"


def _hub_pairs(spark, sf_dir):
    pairs = _edges(spark, sf_dir).select("source_id", F.col("target_id").cast("long").alias("target")).distinct()
    hubs = pairs.groupBy("source_id").agg(F.count("*").alias("degree")).where(F.col("degree") >= HUB)
    return pairs.join(hubs, "source_id", "left_semi")


@register("hub_page", _page_sql(0))
def hub_page(spark, sf_dir):
    """First page of each hub's neighbours."""
    return A.page(_hub_pairs(spark, sf_dir), "source_id", ["target"], 0, PAGE)


@register("continuation_page", _page_sql(PAGE))
def continuation_page(spark, sf_dir):
    """The page after it."""
    return A.page(_hub_pairs(spark, sf_dir), "source_id", ["target"], PAGE, PAGE)


@register("continuation_filtered", _page_sql(0, "SELECT event_type AS source_id, event_id AS target FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-02'"))
def continuation_filtered(spark, sf_dir):
    """First page of each type's events in a temporal range."""
    events = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("event_id").alias("target"), F.date_format("ts", "yyyy-MM-dd").alias("anchor"))
    return A.page(events.where(A.filter_of("temporal_range", ("2024-01-02", None))).drop("anchor"), "source_id", ["target"], 0, PAGE)


_TURN = "conv_id::VARCHAR || ':' || turn::VARCHAR"
_SEEDS = f"""SELECT turn_id, seed_group, text, row_number() OVER (PARTITION BY turn_id ORDER BY g, l, f, i) AS seed_ord FROM (
  SELECT {_TURN} AS turn_id, 0 AS g, 'utterance' AS seed_group, 0 AS l, 0 AS f, 0 AS i, text FROM conversations
  UNION ALL SELECT {_TURN}, 2, 'primary', 0, 1, 0, p FROM (SELECT *, lag(text) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE p IS NOT NULL
  UNION ALL SELECT {_TURN}, 5, 'background', 0, 2, 0, p FROM (SELECT *, lag(text, 2) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE p IS NOT NULL)"""


def _seeds(spark, sf_dir):
    from pyspark.sql import Window

    thread = Window.partitionBy("conv_id").orderBy("turn")
    turns = read_table(spark, sf_dir, "conversations").withColumns({"turn_id": F.concat_ws(":", "conv_id", "turn"), "one": F.lag("text").over(thread), "two": F.lag("text", 2).over(thread)})

    def family(column: str, order: int):
        zero = F.lit(0)
        return turns.where(F.col(column).isNotNull()).select("turn_id", zero.alias("lens_ord"), F.lit(order).alias("family_ord"), zero.alias("item_ord"), F.col(column).alias("text"))

    return A.order_seeds({"utterance": family("text", 0), "primary": family("one", 1), "background": family("two", 2)})


@register("seed_order", _SEEDS)
def seed_order(spark, sf_dir):
    """Seeds of every turn: its text, the turn before and the one before that."""
    return _seeds(spark, sf_dir).select("turn_id", "seed_group", "text", "seed_ord")


@register("seed_bound", f"SELECT turn_id, seed_group, seed_ord FROM ({_SEEDS}) WHERE seed_ord <= 2")
def seed_bound(spark, sf_dir):
    """The first two seeds of every turn."""
    return A.bound_seeds(_seeds(spark, sf_dir), 2).select("turn_id", "seed_group", "seed_ord")


_SURFACES = [("exact", 0, True, ["literal"]), ("lexical", 1, True, ["terms"]), ("vector", 2, False, ["nearest_neighbours"]), ("graph", 3, True, ["incidence"])]


@register("probe_dispatch", f"""SELECT turn_id, seed_ord, surface_id, mode, 'activation-probe:' || (row_number() OVER (PARTITION BY turn_id ORDER BY seed_ord, surface_ord) - 1)::VARCHAR AS probe_id
  FROM (SELECT * FROM ({_SEEDS}) WHERE seed_ord <= 2) CROSS JOIN (VALUES ('exact', 0, 'literal'), ('lexical', 1, 'terms')) s(surface_id, surface_ord, mode)""")
def probe_dispatch(spark, sf_dir):
    """Probes of the first two seeds: text goes to literal and term search, not to incidence."""
    surfaces = spark.createDataFrame(_SURFACES, "surface_id string, surface_ord int, available boolean, match_modes array<string>")
    return A.dispatch(A.bound_seeds(_seeds(spark, sf_dir), 2).withColumn("probe_kind", F.lit("text")), surfaces)


@register("probe_limit", "SELECT event_type, user_id, event_id, position, observed, CASE WHEN observed > 3 THEN 'bounded' ELSE 'complete' END AS truncation FROM (SELECT event_type, user_id, event_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY event_type, user_id) AS observed FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)) WHERE position <= 3")
def probe_limit(spark, sf_dir):
    """At most three candidates of each probe, a type and a user."""
    return A.cap(read_table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], ["event_id"], 3)


@register("activation_telemetry", "SELECT turn_id, probe_ord, surface_id, mode, candidates, 'activation-telemetry:' || (row_number() OVER (PARTITION BY turn_id ORDER BY probe_ord, surface_id, mode) - 1)::VARCHAR AS telemetry_id FROM (SELECT l_orderkey::VARCHAR AS turn_id, l_linenumber AS probe_ord, l_returnflag AS surface_id, l_linestatus AS mode, count(*) AS candidates FROM lineitem GROUP BY ALL)")
def activation_telemetry(spark, sf_dir):
    """Telemetry rows; orders stand for turns, line numbers for probes."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("turn_id"), F.col("l_linenumber").alias("probe_ord"), F.col("l_returnflag").alias("surface_id"), F.col("l_linestatus").alias("mode"))
    return A.telemetry(rows)


@register("edge_dedup", "SELECT turn_id, source_id, transition_id, direction, target_id, 'activated-edge:' || (row_number() OVER (PARTITION BY turn_id ORDER BY o, source_id, target_id) - 1)::VARCHAR AS edge_id FROM (SELECT c_mktsegment AS turn_id, o_custkey::VARCHAR AS source_id, 'ordered' AS transition_id, 'outgoing' AS direction, o_orderpriority AS target_id, min(o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)")
def edge_dedup(spark, sf_dir):
    """Distinct edges from customers to priorities, by market segment."""
    orders, customer = (read_table(spark, sf_dir, t) for t in ("orders", "customer"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return A.distinct_edges(rows.select(F.col("c_mktsegment").alias("turn_id"), F.col("o_custkey").cast("string").alias("source_id"), F.lit("ordered").alias("transition_id"), F.lit("outgoing").alias("direction"), F.col("o_orderpriority").alias("target_id"), F.col("o_orderkey").alias("ord")))


@register("provenance_union", "SELECT user_id, min(a) AS ord, string_agg(event_type, ',' ORDER BY a, event_type) AS provenance FROM (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY ALL) GROUP BY user_id")
def provenance_union(spark, sf_dir):
    """Users at their first event, with their event types in order of appearance."""
    return A.first_seen(read_table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("provenance"), F.col("event_id").alias("ord")), ["user_id"])


@register("upward_closure", "WITH u AS (SELECT o_orderpriority AS turn_id, 'o' || o_orderkey::VARCHAR AS id, o_orderkey AS ord, 'c' || o_custkey::VARCHAR AS c FROM orders), x AS (SELECT turn_id, id, ord FROM u UNION ALL SELECT turn_id, c, ord FROM u UNION ALL SELECT turn_id, 'n' || c_nationkey::VARCHAR, ord FROM u JOIN customer ON c = 'c' || c_custkey::VARCHAR) SELECT turn_id, id, min(ord) AS ord FROM x GROUP BY ALL")
def upward_closure(spark, sf_dir):
    """Orders of each priority with their customers and nations."""
    orders, customer = (read_table(spark, sf_dir, t) for t in ("orders", "customer"))
    up = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent")).unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))
    return A.closure(orders.select(F.col("o_orderpriority").alias("turn_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("ord")), up, 2)


@register("activation_bundle_bound", """WITH RECURSIVE b AS (SELECT turn_id, bundle_ord, needs, row_number() OVER (PARTITION BY turn_id ORDER BY bundle_ord) AS k FROM (SELECT o_custkey::VARCHAR AS turn_id, o_orderkey AS bundle_ord, list_distinct(list(l_partkey)) AS needs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)),
  s AS (SELECT turn_id, k, bundle_ord, len(needs) <= 8 AS placed, CASE WHEN len(needs) <= 8 THEN needs ELSE list_filter(needs, lambda x: false) END AS held, CASE WHEN len(needs) <= 8 THEN len(needs) ELSE 0 END AS added FROM b WHERE k = 1
    UNION ALL SELECT b.turn_id, b.k, b.bundle_ord, len(list_distinct(list_concat(s.held, b.needs))) <= 8, CASE WHEN len(list_distinct(list_concat(s.held, b.needs))) <= 8 THEN list_distinct(list_concat(s.held, b.needs)) ELSE s.held END,
      CASE WHEN len(list_distinct(list_concat(s.held, b.needs))) <= 8 THEN len(list_distinct(list_concat(s.held, b.needs))) - len(s.held) ELSE 0 END FROM s JOIN b ON b.turn_id = s.turn_id AND b.k = s.k + 1)
  SELECT turn_id, bundle_ord, placed, added::BIGINT AS added FROM s""")
def activation_bundle_bound(spark, sf_dir):
    """Bundles (an order's parts) of each customer, as long as at most eight parts are held."""
    orders, lines = (read_table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    bundles = rows.select(F.col("o_custkey").cast("string").alias("turn_id"), F.col("o_orderkey").alias("bundle_ord"), F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("id"))
    return A.place_bundles(bundles, {"part": 8}, Scratch(spark))


@register("expansion", "WITH v AS (SELECT o_custkey::VARCHAR AS turn_id, 'o' || min(o_orderkey)::VARCHAR AS id, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey), n AS (SELECT o_custkey::VARCHAR AS turn_id, 'o' || o_orderkey::VARCHAR AS id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS t FROM orders) SELECT turn_id, id, ord, 'complete' AS state FROM v UNION ALL SELECT turn_id, id, ord, CASE WHEN t - 1 > 4 THEN 'budget_exhausted' ELSE 'complete' END FROM n WHERE k BETWEEN 2 AND 5")
def expansion(spark, sf_dir):
    """Views of each customer's first order, expanded by four more at most."""
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("turn_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    view = rows.groupBy("turn_id").agg(F.min("ord").alias("ord")).select("turn_id", F.concat(F.lit("o"), "ord").alias("id"), "ord")
    return A.expand(view, rows, 4)


@register("activation_config_check", """WITH k AS (SELECT c_custkey AS k, c_custkey % 7 = 5 AS left_out, c_custkey % 5 = 1 AS twice, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AS there, CASE WHEN c_custkey % 6 = 2 THEN -1 ELSE c_custkey % 50 END AS wanted FROM customer)
  SELECT 's' || k::VARCHAR AS surface_id, CASE WHEN left_out THEN 'missing' WHEN NOT there THEN 'unknown_surface' WHEN twice THEN 'repeated' WHEN wanted > 32 THEN 'above_hard_limit' ELSE 'negative' END AS fault FROM k WHERE (left_out AND there) OR (NOT left_out AND (NOT there OR twice OR wanted > 32 OR wanted < 0))""")
def activation_config_check(spark, sf_dir):
    """Faults of a configuration with a surface a customer: some unknown, not available, left out, repeated or beyond a limit."""
    key = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("s"), key.cast("string")).alias("surface_id"))
    surfaces = rows.where("c_custkey % 4 <> 0").select("surface_id", (key % 3 != 0).alias("available"), F.lit(32).cast("long").alias("hard_limit"))
    config = rows.where("c_custkey % 7 <> 5").select("c_custkey", "surface_id", F.when(key % 6 == 2, -1).otherwise(key % 50).cast("long").alias("candidate_limit"))
    return A.config_faults(config.unionByName(config.where("c_custkey % 5 = 1")).drop("c_custkey"), surfaces)
