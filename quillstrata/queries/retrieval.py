"""Retrieval queries: chronology, walks, and the five surfaces.

Parts stand for books, orders for dated contexts, line items for occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.operators import indexes as I
from quillstrata.operators import surfaces as R
from quillstrata.operators import traversal as T
from quillstrata.sources import Scratch, read_table, shared, work_folder
from quillstrata.sources.buckets import Buckets

TERM_CAP, NEIGHBOURS, PREVIEW, HUB, PAGE = 8, 8, 80, 30, 5


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated contexts of each part: distinct (part_key, order_key, anchor_date)."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key")).distinct()
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("anchor_date"))
    return lines.join(orders, "order_key").select("part_key", "order_key", "anchor_date")


_CONTEXTS = "SELECT DISTINCT l_partkey AS part_key, o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS anchor_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _first(direction: str) -> str:
    return f"SELECT part_key, anchor_date, order_key FROM (SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY anchor_date {direction}, order_key {direction}) AS k FROM ({_CONTEXTS})) WHERE k = 1"


@register("chronology_earliest", _first("ASC"))
def chronology_earliest(spark, sf_dir):
    """Where each part occurs first."""
    return T.earliest(contexts(spark, sf_dir), "part_key", ["anchor_date", "order_key"])


@register("chronology_latest", _first("DESC"))
def chronology_latest(spark, sf_dir):
    """Where each part occurs last."""
    return T.earliest(contexts(spark, sf_dir), "part_key", ["anchor_date", "order_key"], latest=True)


@register("chronology_order", f"SELECT part_key, order_key, anchor_date, row_number() OVER (PARTITION BY part_key ORDER BY anchor_date, order_key) AS position FROM ({_CONTEXTS})")
def chronology_order(spark, sf_dir):
    """All contexts of each part in order of time."""
    return T.temporal_order(contexts(spark, sf_dir), "part_key", ["anchor_date", "order_key"])


@register("group_by_binding", f"SELECT part_key, count(*) AS contexts, min(anchor_date) AS first_date, max(anchor_date) AS last_date FROM ({_CONTEXTS}) GROUP BY part_key")
def group_by_binding(spark, sf_dir):
    """Contexts by part."""
    return contexts(spark, sf_dir).groupBy("part_key").agg(F.count("*").alias("contexts"), F.min("anchor_date").alias("first_date"), F.max("anchor_date").alias("last_date"))


def _branches(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return {flag: lines.where(F.col("l_returnflag") == flag).drop("l_returnflag") for flag in ("A", "N", "R")}


@register("join_group", "SELECT l_orderkey, l_linenumber, l_returnflag AS branch FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def join_group(spark, sf_dir):
    """Branches kept apart."""
    return T.group_branches(_branches(spark, sf_dir))


@register("join_concatenate", "SELECT l_orderkey, l_linenumber, l_returnflag AS provenance FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def join_concatenate(spark, sf_dir):
    """Branches appended, with their origin."""
    return T.concatenate(_branches(spark, sf_dir))


@register("join_temporal_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def join_temporal_order(spark, sf_dir):
    """Events of each user as one ordered sequence of merged anchors."""
    return T.temporal_order(read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@register("events_in_order", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def events_in_order(spark, sf_dir):
    """All events as the anchors of one root, in order of time, without a task that sees them all."""
    events = read_table(spark, sf_dir, "events").select(F.lit("all").alias("root"), "event_id", "ts")
    return T.spread_order(events, "root", ["ts", "event_id"], Scratch(spark)).select("event_id", "position")


@register("contexts_in_order", f"SELECT part_key, order_key, anchor_date, row_number() OVER (PARTITION BY part_key ORDER BY anchor_date DESC, order_key) AS position FROM ({_CONTEXTS})")
def contexts_in_order(spark, sf_dir):
    """All contexts of each part, newest first, by ranges of part and date."""
    return T.spread_order(contexts(spark, sf_dir), "part_key", [F.desc("anchor_date"), "order_key"], Scratch(spark))


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment edges region, nation, customer, order."""
    tables = [read_table(spark, sf_dir, t) for t in ("nation", "customer", "orders")]
    steps = (("region", "n_regionkey", "nation", "n_nationkey"), ("nation", "c_nationkey", "customer", "c_custkey"), ("customer", "o_custkey", "order", "o_orderkey"))
    parts = [T.edges(rows, a, x, "contains", b, y) for rows, (a, x, b, y) in zip(tables, steps, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CHAIN = """WITH e AS (SELECT 'region' AS sk, n_regionkey::VARCHAR AS s, 'nation' AS tk, n_nationkey::VARCHAR AS t FROM nation
  UNION ALL SELECT 'nation', c_nationkey::VARCHAR, 'customer', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT 'customer', o_custkey::VARCHAR, 'order', o_orderkey::VARCHAR FROM orders)"""


def _roots(spark, sf_dir):
    return read_table(spark, sf_dir, "region").select(F.col("r_name").alias("root"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("string").alias("id"))


def _walk_sql(depth: int) -> str:
    return _CHAIN.replace("WITH", "WITH RECURSIVE") + f""", w AS (SELECT r_name AS root, 0 AS depth, 'region' AS kind, r_regionkey::VARCHAR AS id FROM region
  UNION ALL SELECT w.root, w.depth + 1, e.tk, e.t FROM w JOIN e ON w.kind = e.sk AND w.id = e.s WHERE w.depth < {depth})"""


@register("containment_walk", _walk_sql(3) + " SELECT root, depth::BIGINT AS depth, kind, count(DISTINCT id) AS reached FROM w GROUP BY ALL")
def containment_walk(spark, sf_dir):
    """What each region contains, by depth."""
    return T.walk(_roots(spark, sf_dir), containment(spark, sf_dir), 3).groupBy("root", "depth", "kind").agg(F.count("*").alias("reached"))


@register("depth_limited_walk", _walk_sql(2) + " SELECT DISTINCT root, depth::BIGINT AS depth, kind, id FROM w")
def depth_limited_walk(spark, sf_dir):
    """Everything within two steps of a region."""
    return T.walk(_roots(spark, sf_dir), containment(spark, sf_dir), 2)


@register("parent_walk", "SELECT o_orderkey AS order_key, c_custkey AS customer_key, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def parent_walk(spark, sf_dir):
    """The containers of each order."""
    orders, customer, nation, region = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    up = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey).join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
    return up.select(F.col("o_orderkey").alias("order_key"), F.col("c_custkey").alias("customer_key"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def _exact(spark, sf_dir):
    documents, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return R.exact(documents, items, "doc_id", "item_id", "text", "text")


_EXACT = "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@register("exact_search", _EXACT)
def exact_search(spark, sf_dir):
    """Documents that hold a benchmark text literally."""
    return _exact(spark, sf_dir)


@register("exact_count", f"SELECT item_id, count(*) AS total FROM ({_EXACT}) GROUP BY item_id")
def exact_count(spark, sf_dir):
    """Exhaustive number of matches of each literal."""
    return _exact(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("total"))


@register("exact_absence", f"SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM ({_EXACT}))")
def exact_absence(spark, sf_dir):
    """Literals that a complete search found nowhere."""
    return read_table(spark, sf_dir, "benchmark").select("item_id").join(_exact(spark, sf_dir), "item_id", "left_anti")


@register("scoped_search", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def scoped_search(spark, sf_dir):
    """Literal search in documents labelled good."""
    documents, labels, items = (read_table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    scoped = R.scope(documents.select("doc_id", "text"), labels.where("quality = 1"), "doc_id")
    return R.exact(scoped, items, "doc_id", "item_id", "text", "text")


_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


@register("term_search", f"""WITH p AS (SELECT item_id, unnest({_TERMS.format('text')}[1:5]) AS term FROM benchmark), r AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
  m AS (SELECT item_id, doc_id, count(*) AS matched FROM (SELECT DISTINCT * FROM p) JOIN r USING (term) GROUP BY ALL)
  SELECT item_id, doc_id, matched, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS position FROM m) WHERE position <= {TERM_CAP}""".replace("[1:5]", ""))
def term_search(spark, sf_dir):
    """The documents with most terms of each benchmark text, up to the surface's cap."""
    documents, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    probes = items.select("item_id", R.terms(F.col("text")).alias("terms"))
    return R.best_terms(documents, probes, "doc_id", "item_id", "text", TERM_CAP)


@register("nearest_neighbours", f"""SELECT probe_id, record_id, position FROM (SELECT p.vec_id AS probe_id, r.vec_id AS record_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_sum(list_transform(list_zip(p.embedding, r.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) DESC, r.vec_id) AS position
  FROM embeddings p JOIN embeddings r ON p.vec_id <> r.vec_id WHERE p.vec_id % 50 = 0) WHERE position <= {NEIGHBOURS}""")
def nearest_neighbours(spark, sf_dir):
    """Nearest vectors of every fiftieth one, the stated query set."""
    vectors = read_table(spark, sf_dir, "embeddings")
    probes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    return R.nearest(vectors.select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector")), probes, NEIGHBOURS)


@register("temporal_range", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) GROUP BY event_type")
def temporal_range(spark, sf_dir):
    """Events from a day after the first, without an end."""
    events = read_table(spark, sf_dir, "events")
    start = events.agg(F.min("ts").alias("first")).select((F.col("first") + F.expr("interval 1 day")).alias("start"))
    inside = events.crossJoin(F.broadcast(start)).where(R.in_range(F.col("ts"), F.col("start"), F.lit(None).cast("timestamp_ntz")))
    return inside.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@register("incidence", "SELECT 'order' AS source_kind, l_orderkey::VARCHAR AS source_id, l_partkey::VARCHAR AS target_id, l_linenumber::BIGINT AS ord FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def incidence(spark, sf_dir):
    """Occurrences that leave urgent orders."""
    table = T.edges(read_table(spark, sf_dir, "lineitem"), "order", "l_orderkey", "order_occurrence", "part", "l_partkey", order="l_linenumber")
    bound = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("source_id"))
    return R.incidence(table, bound, "order_occurrence", "outgoing").select("source_kind", "source_id", "target_id", "ord")


#: Buckets of an index; more for larger corpora.
INDEX_BUCKETS = 16


def _index(spark: SparkSession, sf_dir: str, what: str) -> Buckets:
    """An index of the documents, written once an application."""

    def build() -> Buckets:
        store = Buckets(spark, work_folder(spark), I.KEYS, INDEX_BUCKETS)
        write = {"terms": I.term_index, "literals": I.literal_index}[what]
        write(store, read_table(spark, sf_dir, "documents"), "doc_id", "text")
        return store

    return shared(spark, sf_dir, ("documents",), f"index of {what}", build)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = I.literal(_index(spark, sf_dir, "literals"), read_table(spark, sf_dir, "benchmark"), "item_id", "text", Scratch(spark))
    return found.withColumnRenamed("record_id", "doc_id")


@register("exact_search_indexed", _EXACT)
def exact_search_indexed(spark, sf_dir):
    """Documents that hold a benchmark text literally, by the index of triples."""
    return _indexed(spark, sf_dir)


@register("exact_absence_indexed", f"SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM ({_EXACT}))")
def exact_absence_indexed(spark, sf_dir):
    """Literals that the index proves to be nowhere."""
    return read_table(spark, sf_dir, "benchmark").select("item_id").join(_indexed(spark, sf_dir), "item_id", "left_anti")


_RANKED = """WITH p AS (SELECT item_id, unnest({terms}) AS term FROM benchmark), r AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
  m AS (SELECT item_id, doc_id, count(*) AS matched FROM (SELECT DISTINCT * FROM p) JOIN r USING (term) GROUP BY ALL)
  SELECT item_id, doc_id, matched, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS position FROM m) WHERE position <= {cap}"""


@register("term_search_indexed", _RANKED.format(terms=_TERMS.format("text"), cap=TERM_CAP))
def term_search_indexed(spark, sf_dir):
    """The documents with most terms of each benchmark text, by the index of terms."""
    probes = read_table(spark, sf_dir, "benchmark").select("item_id", R.terms(F.col("text")).alias("terms"))
    best, _ = I.ranked(_index(spark, sf_dir, "terms"), probes, "item_id", TERM_CAP, Scratch(spark))
    return best.select("item_id", F.col("record_id").alias("doc_id"), "matched", "position")
