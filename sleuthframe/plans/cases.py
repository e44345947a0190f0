"""Registered queries of resolution, loading, state, risk and text keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, detect, edges, graph, resolve, risk, state
from ..sources import adapters, loaders
from . import domain
from .catalog import CONTACTS, ORACLE_SQL, PURCHASES, TRADE, TUNED, ledger, query, refs

PEOPLE = """SELECT 'C' || c_custkey AS id, c_name AS name, '+91-9' || lpad(c_custkey::VARCHAR, 9, '0') AS phone, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BANK_ACCOUNT' ELSE 'PERSON' END AS entity_type FROM customer"""
SURVIVOR = "'C' || (c_custkey - c_custkey % 3 + CASE WHEN c_custkey < 3 THEN 1 ELSE 0 END)"


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three customers in a row are one (the first two, should there be no third)."""
    key = F.col("c_custkey")
    to = key - key % 3 + F.when(key < 3, 1).otherwise(0)
    c = domain.table(spark, sf_dir, "customer")
    return c.select(F.lit(domain.CASE).alias("case_id"), F.concat(F.lit("C"), key.cast("string")).alias("id"), F.concat(F.lit("C"), to.cast("string")).alias("survivor"))


# ---------------------------------------------------------------- resolution


@query()
def r6_resolve_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all customers with their rules. Four in a row bear variants of a name; the
    first, second and fourth share a phone. (SQL knows no name similarity.)"""
    pairs = resolve.classify_pairs(resolvable(spark, sf_dir))
    return pairs.where("rule is not null").select("a", "b", F.round("sim", 6).alias("sim"), "rule")


def resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.table(spark, sf_dir, "customer")
    key, group = F.col("c_custkey"), F.floor(F.col("c_custkey") / 4).cast("string")
    first = F.concat(F.lit("Given"), group)
    name = F.when(key % 4 == 0, F.concat(first, F.lit(" Family"), group)).when(key % 4 == 1, F.concat(F.lit("G. Family"), group)).when(key % 4 == 2, F.concat(first, F.lit(" K Family"), group)).otherwise(F.concat(F.lit("Zed Quux"), group))
    phone = F.when(key % 4 == 2, F.format_string("+91-8%09d", "c_custkey")).otherwise(F.format_string("9%09d", (F.floor(key / 4)).cast("int")))
    return c.select(F.lit(domain.CASE).alias("case_id"), F.concat(F.lit("C"), key.cast("string")).alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(phone).alias("phone_numbers"), F.lit("PERSON").alias("entity_type"), F.lit(50.0).alias("base_risk_score"))


@query(f"""
WITH p AS (SELECT p.*, {SURVIVOR} AS survivor FROM ({PEOPLE}) p JOIN customer ON p.id = 'C' || c_custkey),
n AS (SELECT survivor, name, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT survivor, name, row_number() OVER (PARTITION BY survivor ORDER BY n DESC, length(name) DESC, name DESC) AS k FROM n)
SELECT survivor AS id, any_value(r.name) AS name, string_agg(p.name, '|' ORDER BY p.name) FILTER (p.name <> r.name) AS aliases, string_agg(phone, '|' ORDER BY phone) AS phones, min_by(entity_type, p.id) AS entity_type
FROM p JOIN r USING (survivor) WHERE k = 1 GROUP BY survivor""")
def r7_merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _, _ = resolve.merge_entities(domain.people(spark, sf_dir), domain.purchases(spark, sf_dir), mapping(spark, sf_dir))
    aliases = F.array_join("aliases", "|")
    return merged.select("id", "name", F.when(F.size("aliases") > 0, aliases).alias("aliases"), F.array_join("phone_numbers", "|").alias("phones"), "entity_type")


@query(f"""
WITH m AS (SELECT 'C' || c_custkey AS source_id, {SURVIVOR} AS survivor FROM customer)
SELECT CASE WHEN survivor <> source_id THEN e.id || '::' || source_id || '->' || survivor ELSE e.id END AS id, survivor AS source_id, target_id FROM ({PURCHASES}) e JOIN m USING (source_id)""")
def r7_moved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, moved, _ = resolve.merge_entities(domain.people(spark, sf_dir), domain.purchases(spark, sf_dir), mapping(spark, sf_dir))
    return moved.select("id", "source_id", "target_id")


@query(f"SELECT id, source_id, target_id FROM ({PURCHASES})")
def r10_unmerged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after all merges are undone: those before."""
    e = domain.purchases(spark, sf_dir)
    merged, moved, log = resolve.merge_entities(domain.people(spark, sf_dir), e, mapping(spark, sf_dir))
    _, back = resolve.unmerge(merged, moved, e, log)
    return back.select("id", "source_id", "target_id")


@query(f"""
WITH l AS (SELECT {SURVIVOR} AS survivor, list('C' || c_custkey ORDER BY 'C' || c_custkey) AS ids FROM customer GROUP BY 1), m AS (SELECT unnest(ids) AS id, 'MERGE-' || upper(substr(sha256(survivor || '|' || array_to_string(ids, '|') || '|exact_anchor+name'), 1, 12)) AS merge FROM l)
SELECT p.id, name, merge FROM ({PEOPLE}) p JOIN m USING (id)""")
def j12_entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = domain.people(spark, sf_dir)
    _, _, log = resolve.merge_entities(people, domain.purchases(spark, sf_dir), mapping(spark, sf_dir))
    sources = spark.createDataFrame([], state.TABLES["entity_sources"])
    return resolve.entity_detail(people, sources, log).select("id", "name", F.array_join("merges", ",").alias("merge"))


# ---------------------------------------------------------------- loading

CALLS = """SELECT event_id, '9' || lpad(user_id::VARCHAR, 9, '0') AS caller, '9' || lpad((event_id % 3000)::VARCHAR, 9, '0') AS callee, ts, event_id % 600 AS secs FROM events"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    return e.select(F.format_string("09%09d", "user_id").alias("caller"), F.format_string("+91 9%09d", F.col("event_id") % 3000).alias("callee"), stamp, (F.col("event_id") % 600).cast("int").alias("duration_sec"))


@query(f"""
WITH o AS (SELECT '9' || lpad(c_custkey::VARCHAR, 9, '0') AS p, 'C' || c_custkey AS o FROM customer),
c AS (SELECT coalesce(a.o, 'PHONE-' || caller) AS source_id, coalesce(b.o, 'PHONE-' || callee) AS target_id, 'CDR ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || secs || 's' AS evidence_source FROM ({CALLS}) LEFT JOIN o a ON a.p = caller LEFT JOIN o b ON b.p = callee)
SELECT source_id || '->' || target_id || ':CALLED:' || substr(sha256(evidence_source), 1, 16) AS id, source_id, target_id, evidence_source, 0.92::DOUBLE AS confidence_score FROM c WHERE source_id <> target_id""")
def sc16_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between the owners of phones, or the phones themselves."""
    e = loaders.cdr_edges(calls(spark, sf_dir), domain.people(spark, sf_dir), domain.CASE)
    return e.select("id", "source_id", "target_id", "evidence_source", "confidence_score")


@query(f"""
WITH o AS (SELECT '9' || lpad(c_custkey::VARCHAR, 9, '0') AS p FROM customer), x AS (SELECT caller AS p, callee AS q FROM ({CALLS}) UNION ALL SELECT callee, caller FROM ({CALLS}))
SELECT DISTINCT 'PHONE-' || p AS id, '+91-' || p AS phone, 'PHONE' AS entity_type FROM x WHERE p <> q AND p NOT IN (SELECT p FROM o)""")
def sc16_phone_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = domain.people(spark, sf_dir)
    n = loaders.end_nodes(loaders.cdr_edges(calls(spark, sf_dir), people, domain.CASE), people)
    return n.select("id", F.get("phone_numbers", F.lit(0)).alias("phone"), "entity_type")


@query("""
WITH t AS (SELECT CASE WHEN a <= 500 THEN 'C' || a ELSE 'ACCT-Customer#' || lpad(a::VARCHAR, 9, '0') END AS source_id, 'ACCT-S' || l_suppkey AS target_id, 'TXN ' || strftime(l_shipdate, '%Y-%m-%d') || ' INR ' || l_quantity AS evidence_source
 FROM (SELECT *, o_custkey AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
SELECT source_id, target_id, evidence_source, count(*) AS n FROM t GROUP BY ALL""")
def sc17_transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers between accounts; accounts that bear a known entity's name are that entity."""
    rows = domain.table(spark, sf_dir, "lineitem").join(domain.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    txns = rows.select(F.format_string("Customer#%09d", "o_custkey").alias("from_acct"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_acct"), F.col("l_quantity").alias("amount_inr"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    known = domain.people(spark, sf_dir).where(F.substring("id", 2, 20).cast("long") <= 500)
    e = loaders.account_owner(loaders.txn_edges(txns, domain.CASE), known)
    return e.groupBy("source_id", "target_id", "evidence_source").agg(F.count("*").alias("n"))


RECORDS = "SELECT 'R' || c_custkey AS record_id, c_name AS name, c_mktsegment || ' | ' || lower(c_mktsegment) || ';;' AS aliases, '9' || lpad(c_custkey::VARCHAR, 9, '0') AS phone, 'K' || (c_custkey % 7) || '|K' || (c_custkey % 5) AS prior_case_ids FROM customer"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    cases = F.concat(F.lit("K"), (key % 7).cast("string"), F.lit("|K"), (key % 5).cast("string"))
    return c.select(F.concat(F.lit("R"), key.cast("string")).alias("record_id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit(" | "), F.lower("c_mktsegment"), F.lit(";;")).alias("aliases"), F.format_string("9%09d", key).alias("phone"), cases.alias("prior_case_ids"))


NODE = "'ENT-' || upper(substr(sha256('CASE-1|person|' || lower({0}) || '||'), 1, 10))"


@query(f"""
WITH r AS ({RECORDS}), n AS (SELECT {NODE.format('name')} AS id, name, list_sort([trim(string_split(aliases, '|')[1]), lower(trim(string_split(aliases, '|')[1]))]) AS al, '+91-' || phone AS phones, 'PERSON' AS entity_type FROM r),
k AS (SELECT DISTINCT unnest(string_split(prior_case_ids, '|')) AS c FROM r)
SELECT id, name, array_to_string(al, '|') AS aliases, phones, entity_type FROM n UNION ALL SELECT 'CASE-' || c, c, '', '', 'CASE' FROM k""")
def sc11_record_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criminal records as entities: people with aliases and phones, and the cases they are tied to."""
    n = adapters.person_nodes(adapters.get_adapter("criminal_history")(records(spark, sf_dir)), domain.CASE)
    return n.select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("phone_numbers", "|").alias("phones"), "entity_type")


@query(f"""
SELECT DISTINCT s || '->CASE-' || c || ':ASSOCIATED_WITH' AS id, s AS source_id, 'CASE-' || c AS target_id, 0.9::DOUBLE AS confidence_score, 'criminal_history:' || record_id AS evidence_source FROM (SELECT record_id, {NODE.format('name')} AS s, unnest(string_split(prior_case_ids, '|')) AS c FROM ({RECORDS}))""")
def r15_relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.relation_edges(adapters.get_adapter("criminal_history")(records(spark, sf_dir)), domain.CASE)
    return e.select("id", "source_id", "target_id", "confidence_score", "evidence_source")


@query("SELECT 'edge' AS kind, 'TRANSFER' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'node', CASE WHEN c_mktsegment = 'BUILDING' THEN 'BANK_ACCOUNT' ELSE 'PERSON' END, count(*) FROM customer GROUP BY 2")
def a14_ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ingest_stats(domain.people(spark, sf_dir), domain.purchases(spark, sf_dir))


# ---------------------------------------------------------------- state


@query("SELECT 'U' || user_id AS edge_id, min_by(props, event_id) AS details FROM events GROUP BY 1")
def sc3_first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events")
    return edges.first_evidence(e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("edge_id"), F.col("event_id").alias("id"), F.col("props").alias("details")))


@query(f"SELECT e.id, source_id, props AS details FROM ({CONTACTS}) e LEFT JOIN (SELECT 'E' || lpad(event_id::VARCHAR, 12, '0') AS id, props FROM events WHERE event_id % 2 = 0) USING (id) WHERE source_id <> target_id")
def j1_edges_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their first evidence, where there is any."""
    e = domain.table(spark, sf_dir, "events")
    key = F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    proof = e.where("event_id % 2 = 0").select(key.alias("edge_id"), F.col("event_id").alias("id"), F.col("props").alias("details"))
    plain = domain.contacts(spark, sf_dir).withColumn("evidence_source", F.lit("")).drop("ts", "amount", "is_call", "is_txn")
    return edges.enrich(plain, proof).select("id", "source_id", "details")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type as one link under review."""
    e = domain.table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "APPROVE").when(F.col("event_id") % 3 == 1, "PENDING").otherwise("UNREVIEWED")
    pair = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.max("value").alias("value"))
    return pair.select(F.lit(domain.CASE).alias("case_id"), F.concat_ws(":", F.concat(F.lit("U"), F.col("user_id").cast("string")), "event_type").alias("id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_id"), F.lit("DESK").alias("target_id"), F.upper("event_type").alias("relation_type"), "value", status.alias("status"), F.when(status == "APPROVE", "me").alias("reviewer"), F.lit(None).cast("string").alias("reviewed_at"))


LINKS = "SELECT 'U' || user_id || ':' || event_type AS id, min(event_id) AS e, max(value) AS value, user_id FROM events GROUP BY user_id, event_type"


@query(f"SELECT id, CASE e % 3 WHEN 1 THEN 'PENDING' ELSE 'UNREVIEWED' END AS status FROM ({LINKS}) WHERE e % 3 <> 0")
def f8_pending_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_links(links(spark, sf_dir)).select("id", "status")


@query(f"SELECT id, value + 1 AS value, CASE e % 3 WHEN 0 THEN 'APPROVE' ELSE 'PENDING' END AS status, CASE e % 3 WHEN 0 THEN 'me' END AS reviewer FROM ({LINKS})")
def sk2_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that come again, all pending: new values, but decided reviews stay."""
    stored = links(spark, sf_dir)
    again = stored.withColumns({"value": F.col("value") + 1, "status": F.lit("PENDING"), "reviewer": F.lit(None).cast("string")})
    return state.upsert_edges(stored, again).select("id", "value", "status", "reviewer")


@query(f"SELECT id, CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END AS value FROM ({LINKS})")
def sk3_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = links(spark, sf_dir)
    stored = every.where(F.substring("source_id", 2, 20).cast("long") % 2 == 0)
    return state.insert_ignore(stored, every.withColumn("value", F.lit(0.0)), ["id"]).select("id", "value")


@query("SELECT 'U' || user_id AS edge_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS props FROM (SELECT user_id, event_type, max('v' || event_id) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def sk5_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("edge_id"), F.col("event_type").alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))
    text = F.array_join(F.transform(F.map_entries("props"), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    return state.properties(e).select("edge_id", text.alias("props"))


@query(f"SELECT id, source_id, target_id FROM ({CONTACTS}) WHERE source_id <> target_id AND (source_id IN ('U1', 'U2', 'U3') OR target_id IN ('U1', 'U2', 'U3'))")
def f9_incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.createDataFrame([("U1",), ("U2",), ("U3",)], "id string")
    return edges.incident(domain.contacts(spark, sf_dir), nodes).select("id", "source_id", "target_id").distinct()


@query(f"SELECT id AS link_id, source_id AS source, target_id AS target, conf AS confidence FROM ({CONTACTS}) WHERE source_id <> target_id")
def f14_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state.checked(domain.contacts(spark, sf_dir)).withColumn("status", F.lit("PENDING"))
    return state.graph_links(e).select("link_id", "source", "target", "confidence")


@query(f"SELECT * FROM ({PEOPLE}) WHERE entity_type = 'PERSON'")
def f7_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = state.entities_of(domain.people(spark, sf_dir), domain.CASE).where(F.upper("entity_type") == "PERSON")
    return people.select("id", "name", F.get("phone_numbers", F.lit(0)).alias("phone"), "entity_type")


@query(f"SELECT id, rule_id, refs, score, 'dismissed' AS status FROM ({ORACLE_SQL['scan_new_findings']}) WHERE rule_id = 'A4_odd_hour_activity'")
def f11_dismissed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one status, after all night findings were dismissed."""
    found = detect.scan(domain.contacts(spark, sf_dir), TUNED, ("A2", "A4"))
    stored = detect.set_status(found, found.where("rule_id = 'A4_odd_hour_activity'").select("id", F.lit("dismissed").alias("status")))
    return detect.list_findings(stored, domain.CASE, "dismissed").select("id", "rule_id", refs(), F.round("score", 6).alias("score"), "status")


# ---------------------------------------------------------------- risk, graph, ledger


@query(f"""
WITH j AS (SELECT p.id, coalesce(n, 0) AS n, l, c, tier FROM (SELECT id, likelihood AS l, consequence AS c, tier FROM ({ORACLE_SQL['k3_threat_scores']})) p LEFT JOIN (SELECT source_id AS id, count(*) AS n FROM ({PURCHASES}) GROUP BY 1) USING (id))
SELECT id, CASE WHEN n = 0 THEN 'no links' ELSE 'likelihood ' || l || '/5 from ' || n || ' links' END || '; consequence ' || c || '/5; matrix tier ' || tier AS factors FROM j""")
def k4_risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = risk.threat_scores(domain.people(spark, sf_dir), domain.purchases(spark, sf_dir))
    return scores.select("id", F.array_join("contributing_factors", "; ").alias("factors"))


@query(f"SELECT id, threat_score, risk_level FROM ({ORACLE_SQL['k3_threat_scores']}) WHERE substr(id, 2)::BIGINT BETWEEN 1 AND 40")
def k5_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of asked ids; those that nobody bears are passed over."""
    scores = risk.threat_scores(domain.people(spark, sf_dir), domain.purchases(spark, sf_dir))
    return risk.batch_scores(scores, [*(f"C{k}" for k in range(1, 41)), "X1"]).select("id", "threat_score", "risk_level")


@query(f"WITH e AS (SELECT DISTINCT source_id, target_id FROM ({TRADE})) SELECT 'CASE-1' AS case_id, (SELECT count(*) FROM (SELECT source_id FROM e UNION SELECT target_id FROM e)) AS nodes, count(*) AS links FROM e")
def g10_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.trade(spark, sf_dir)
    nodes = e.select("case_id", F.col("source_id").alias("id")).distinct()
    return graph.graph_analytics(nodes, e, 1)["counts"].select("case_id", "nodes", "links")


@query("SELECT (event_id <> 500) AS hash_ok, (event_id <> 502) AS link_ok, count(*) AS n FROM events WHERE event_id <> 501 GROUP BY ALL")
def l2_tampered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with one entry changed and one removed: both are found, and nothing else."""
    chain = ledger(spark, sf_dir).where("id <> 501").withColumn("action", F.when(F.col("id") == 500, "changed").otherwise(F.col("action")))
    return audit.verify_chain(chain).groupBy("hash_ok", "link_ok").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text and keys


@query("""
SELECT c_custkey, '+91-9' || lpad(c_custkey::VARCHAR, 9, '0') AS phone, 'r kumar|kumar' AS variants, c_mktsegment || '|b|c' AS parts, 'Met ' || c_name || '.|Then left|for home' AS paragraphs,
 'MERGE-' || upper(substr(sha256('C' || c_custkey || '|A|B|' || 'auto_r1'), 1, 12)) AS merge_id, 'fir:F' || c_custkey || ':' || substr(sha256(c_name), 1, 16) AS run_key,
 'ENT-' || upper(substr(sha256('CASE-1|person|' || lower(c_name) || '|9|'), 1, 10)) AS node, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02T03:04:05+00:00' ELSE 'noon' END AS at FROM customer""")
def x2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones, name variants, split values, paragraphs, ids and times of every customer."""
    c = domain.table(spark, sf_dir, "customer")
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    variants = F.array_join(F.array_sort(S.name_variants(F.lit("Shri R. Kumar")), lambda a, b: F.length(b) - F.length(a)), "|")
    return c.select(
        "c_custkey", S.canonical_phone(F.format_string("09%09d", key)).alias("phone"), variants.alias("variants"), F.array_join(S.split_multi(F.concat("c_mktsegment", F.lit("| b;;c,"))), "|").alias("parts"),
        F.array_join(S.paragraphs(F.concat(F.lit("Met "), "c_name", F.lit(". Then left\n\nfor home"))), "|").alias("paragraphs"), S.merge_id(F.concat(F.lit("C"), text), F.array(F.lit("B"), F.lit("A")), F.lit("auto_r1")).alias("merge_id"),
        S.run_key(F.lit("fir"), F.concat(F.lit("F"), text), "c_name").alias("run_key"), S.node_id(F.lit(domain.CASE), F.lit("person"), "c_name", F.array(F.lit("9"))).alias("node"),
        S.normalize_ts(F.when(key % 2 == 0, "2024-01-02 03:04:05").otherwise("noon")).alias("at"),
    )
