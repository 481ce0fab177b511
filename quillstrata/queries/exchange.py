"""Exchange queries: identities, strict decoding, schemas and validation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstrata.catalogue import register
from quillstrata.functions import identity, records, schemas
from quillstrata.operators import validation
from quillstrata.sources import read_table

_MD5 = "md5(c_custkey::VARCHAR)"
_HYPHENS = "concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21, 12))"


@register("object_id_parse", f"SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN {_HYPHENS} END AS object_id FROM (SELECT c_custkey, {_MD5} AS m FROM customer)")
def object_id_parse(spark, sf_dir):
    """Object ids of customers in four spellings, and one that is none."""
    digest = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    plain = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    k = F.col("c_custkey") % 5
    spelled = F.when(k == 0, digest).when(k == 1, F.upper(plain)).when(k == 2, F.concat(F.lit("{"), plain, F.lit("}"))).when(k == 3, F.concat(F.lit("urn:uuid:"), plain)).otherwise(F.concat(plain, F.lit("0")))
    return read_table(spark, sf_dir, "customer").select("c_custkey", identity.object_id(spelled).alias("object_id"))


@register("opaque_id_parse", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS opaque_id FROM events")
def opaque_id_parse(spark, sf_dir):
    """Opaque ids; every third one is blank."""
    raw = F.when(F.col("event_id") % 3 == 0, F.lit(" \n ")).otherwise(F.col("event_type"))
    return read_table(spark, sf_dir, "events").select("event_id", identity.opaque_id(raw).alias("opaque_id"))


@register("region_address_parse", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {_HYPHENS} END AS object_id, CASE WHEN c_custkey % 2 = 0 THEN 'h1' END AS address FROM (SELECT c_custkey, {_MD5} AS m FROM customer)")
def region_address_parse(spark, sf_dir):
    """Region addresses; every second one is blank."""
    address = F.when(F.col("c_custkey") % 2 == 0, "h1").otherwise("  ")
    parsed = identity.region_address(F.md5(F.col("c_custkey").cast("string").cast("binary")), address)
    return read_table(spark, sf_dir, "customer").select("c_custkey", parsed.alias("a")).select("c_custkey", "a.object_id", "a.address")


_VARIANTS = ("object", "region", "unit", "identifier", "occurrence", "temporal_anchor", "retrieval_surface", "other")


@register("address_kind", "SELECT p_partkey, ([" + ", ".join(f"'{x}'" for x in _VARIANTS) + "])[(p_partkey % 8)::INT + 1] AS variant, ([" + ", ".join("NULL" if x == "other" else f"'semantic_{x}'" if x in ("object", "region", "unit") else f"'{x}'" for x in _VARIANTS) + "])[(p_partkey % 8)::INT + 1] AS kind FROM part")
def address_kind(spark, sf_dir):
    """Kinds of addresses of every variant, one a part; one in eight is no address."""
    variants = F.array(*map(F.lit, _VARIANTS))
    addresses = read_table(spark, sf_dir, "part").select("p_partkey", variants[(F.col("p_partkey") % 8).cast("int")].alias("variant"))
    return addresses.select("p_partkey", "variant", identity.address_kind(F.col("variant")).alias("kind"))


@register("strict_decode", "SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN '$.extra' WHEN 2 THEN '$.role' WHEN 3 THEN '$.turn' END AS fault_path, CASE turn % 4 WHEN 1 THEN 'unknown field' WHEN 2 THEN 'unknown variant' WHEN 3 THEN 'missing field' END AS fault FROM conversations")
def strict_decode(spark, sf_dir):
    """Turns as JSON, three in four made faulty, with the fault that decoding finds."""
    k = F.col("turn") % 4
    whole = F.struct("conv_id", "turn", "role", "text")
    text = F.when(k == 1, F.to_json(F.struct("conv_id", "turn", "role", "text", F.lit(1).alias("extra")))).when(k == 2, F.to_json(F.struct("conv_id", "turn", F.lit("robot").alias("role"), "text"))).when(k == 3, F.to_json(F.struct("conv_id", "role", "text"))).otherwise(F.to_json(whole))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("json"))
    return records.check_json(rows, "json", "chat-turn").select("conv_id", "turn", "fault_path", "fault")


@register("json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark, sf_dir):
    """Turns encoded as JSON and decoded again."""
    rows = read_table(spark, sf_dir, "conversations")
    decoded = F.from_json(F.to_json(F.struct(*rows.columns)), rows.schema)
    return rows.select(decoded.alias("r")).select("r.*")


def _exchanged():
    """JSON texts of four kinds of records for every turn, three in four made faulty: (record, text)."""
    k = F.col("turn") % 4
    identity_ = F.concat_ws(":", F.lit("u"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    utterance = F.when(k == 1, F.to_json(F.struct(identity_.alias("utterance_id")))).when(k == 2, F.to_json(F.struct(identity_.alias("utterance_id"), F.lit(1).alias("text")))).when(k == 3, F.lit("{")).otherwise(F.to_json(F.struct(identity_.alias("utterance_id"), F.lit("x").alias("text"))))
    preview = F.when(k == 1, F.lit('{"kind":"inline","text":"x"}')).when(k == 2, F.lit('{"kind":"cut"}')).when(k == 3, F.lit('{"kind":"unavailable_without_hydration","text":"x"}')).otherwise(F.lit('{"kind":"unavailable_without_hydration"}'))
    result = F.when(k == 1, F.lit('{"status":"valid","plan_id":"p"}')).when(k == 2, F.lit('{"status":"invalid","plan_id":"p","projection_snapshot_id":"s","violations":{"first":{"code":"no_such_code","detail":{"kind":"surface","surface_id":"x","address_kind":"identifier"}},"additional":[]}}')).when(k == 3, F.lit('{"plan_id":"p"}')).otherwise(F.lit('{"status":"valid","plan_id":"p","projection_snapshot_id":"s"}'))
    subject = F.when(k == 1, F.lit('{"kind":"object","value":"no uuid"}')).when(k == 2, F.lit('{"kind":"unit","value":" "}')).when(k == 3, F.lit('{"kind":"region","value":{"object_id":"00000000-0000-0000-0000-000000000001"}}')).otherwise(F.lit('{"kind":"identifier","value":{"identifier_name":"x","represented_value":null}}'))
    anchor = F.concat(F.lit('{"anchor_id":"a","subject":'), subject, F.lit(',"value":{"precision":"year","value":1999},"record_provenance":{"kind":"materialization","rule":"r","sources":[]},"available_surface_ids":[],"activation_provenance":[{"kind":"newest_utterance","utterance_id":"u"}]}'))
    return {"activation-utterance": utterance, "activated-text-preview": preview, "conformance-result": result, "activated-temporal-anchor-record": anchor}


# What decoding finds, by record and place of the turn: (record, turn mod 4, path, fault).
_FAULTS = [
    ("activation-utterance", 1, "$.text", "missing field"), ("activation-utterance", 2, "$.text", "expected a string"), ("activation-utterance", 3, "$", "malformed JSON"),
    ("activated-text-preview", 1, "$.truncated", "missing field"), ("activated-text-preview", 2, "$.kind", "unknown variant"), ("activated-text-preview", 3, "$.text", "unknown field"),
    ("conformance-result", 1, "$.projection_snapshot_id", "missing field"), ("conformance-result", 2, "$.violations.first.code", "unknown variant"), ("conformance-result", 3, "$.status", "missing tag"),
    ("activated-temporal-anchor-record", 1, "$.subject.value", "expected a UUID"), ("activated-temporal-anchor-record", 2, "$.subject.value", "expected a string that is not blank"), ("activated-temporal-anchor-record", 3, "$.subject.value.authored_structural_address", "missing field"),
]
_FAULT_SQL = ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in _FAULTS)


@register("record_faults", f"SELECT r.record, conv_id, turn, fault_path, fault FROM conversations CROSS JOIN (SELECT DISTINCT record FROM (VALUES {_FAULT_SQL}) v(record, k, p, f)) r LEFT JOIN (VALUES {_FAULT_SQL}) v(record, k, fault_path, fault) ON v.record = r.record AND turn % 4 = v.k")
def record_faults(spark, sf_dir):
    """The first fault of records of four kinds, tagged unions and addresses among them."""
    result = None
    for name, text in _exchanged().items():
        rows = read_table(spark, sf_dir, "conversations").select(F.lit(name).alias("record"), "conv_id", "turn", text.alias("json"))
        part = records.check_json(rows, "json", name).select("record", "conv_id", "turn", "fault_path", "fault")
        result = part if result is None else result.unionByName(part)
    return result


@register("schema_export")
def schema_export(spark, sf_dir):
    """JSON Schema documents of all records, and how many turns of the conversations are valid records of each."""
    documents = spark.createDataFrame([(n, records.json_schema(n)) for n in schemas.RECORDS], "name string, document string")
    turns = read_table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("json"))
    valid = records.check_json(turns, "json", "chat-turn").where("fault is null").agg(F.count("*").alias("valid")).withColumn("name", F.lit("chat-turn"))
    return documents.join(F.broadcast(valid), "name", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))


@register("validation_report", """SELECT * FROM (
  SELECT 'lines_have_orders' AS check_name, count(*) AS failures FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'lines_have_parts', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'orders_have_customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'orders_unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'labels_unique', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'labels_have_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'units_counted', 0)""")
def validation_report(spark, sf_dir):
    """Integrity checks over the stand-in tables, with numbers of failures."""
    t = {name: read_table(spark, sf_dir, name) for name in ("lineitem", "orders", "part", "customer", "labels", "documents")}
    checks = {
        "lines_have_orders": validation.unresolved(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
        "lines_have_parts": validation.unresolved(t["lineitem"], "l_partkey", t["part"], "p_partkey"),
        "orders_have_customers": validation.unresolved(t["orders"], "o_custkey", t["customer"], "c_custkey"),
        "orders_unique": validation.repeated(t["orders"], ["o_orderkey"]),
        "labels_unique": validation.repeated(t["labels"], ["doc_id"]),
        "labels_have_documents": validation.unresolved(t["labels"], "doc_id", t["documents"], "doc_id"),
        "units_counted": validation.miscounted(t["documents"].select("doc_id", F.size(F.split("text", "\n")).alias("declared")), t["documents"].select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "doc_id", "declared"),
    }
    return validation.report(checks).select("check_name", "failures")
