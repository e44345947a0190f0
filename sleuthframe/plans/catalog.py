"""The registered queries of the analytics and, for each, DuckDB SQL of the same result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Detection
from ..functions import scalars as S
from ..operators import audit, detect, edges, graph, risk, state
from . import domain

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Thresholds that give these tables findings; the defaults are in the configuration.
TUNED = Detection(follow_hours=6, hub_peers=45, odd_times=1.2, odd_ratio=0.25, burst_z=2.0)


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


def refs() -> Column:
    """What a finding's evidence refers to, as one text."""
    return F.array_join(F.transform("evidence", lambda e: e["reference"]), ",").alias("refs")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- relations in SQL

CONTACTS = """SELECT 'E' || lpad(event_id::VARCHAR, 12, '0') AS id, 'U' || user_id AS source_id, 'U' || ((event_id * 7919 + user_id * 104729) % 211) AS target_id, ts, 0.5 + (event_id % 50) / 100.0::DOUBLE AS conf FROM events"""
PURCHASES = """SELECT 'L' || lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_linenumber::VARCHAR, 2, '0') AS id, 'C' || o_custkey AS source_id, 'S' || l_suppkey AS target_id, o_orderdate AS ts, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
TRADE = """SELECT 'L' || lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_linenumber::VARCHAR, 2, '0') AS id, 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS source_id, 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS target_id, o_orderdate AS ts, 0.5 + l_quantity / 100.0 AS conf
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 48 AND l_discount >= 0.09 AND c_nationkey <> s_nationkey"""
ENDS = "SELECT id, source_id AS node, target_id AS peer, {0} FROM e UNION ALL SELECT id, target_id, source_id, {0} FROM e"


# ---------------------------------------------------------------- statistical detectors


@query(f"""
WITH e AS MATERIALIZED ({PURCHASES}), w AS (SELECT *, round_even(amount, 0) AS whole FROM e), b AS MATERIALIZED (SELECT id, source_id AS node, amount, whole FROM w UNION ALL SELECT id, target_id, amount, whole FROM w),
m AS (SELECT node, median(whole) AS med, mad(whole) AS d, count(*) AS n FROM b GROUP BY 1), k AS (SELECT median(whole) AS cm, mad(whole) AS cd FROM w),
j AS (SELECT b.*, n < 5 AS fallback, CASE WHEN n >= 5 THEN med ELSE cm END AS med, CASE WHEN n >= 5 THEN d ELSE cd END AS d FROM b JOIN m USING (node), k),
z AS (SELECT *, CASE WHEN d = 0 THEN (whole - med) / greatest(1, abs(med)) ELSE 0.6745::DOUBLE * (whole - med) / d END AS z FROM j),
s AS (SELECT *, greatest(0, least(1, 0.4::DOUBLE + 0.08::DOUBLE * z)) AS score FROM z WHERE z >= 3.5),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, id) AS k FROM s)
SELECT node, id AS edge_id, id AS refs, amount, round(z, 6) AS z, fallback, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM r WHERE k = 1""")
def a1_amount_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.amount_outlier(domain.purchases(spark, sf_dir))
    return r6(out.select("node", "edge_id", refs(), "amount", "z", "fallback", "score", "severity"), "z", "score")


@query(f"""
WITH e AS (SELECT * FROM ({CONTACTS}) WHERE source_id <> target_id), b AS ({ENDS.format('ts')}),
g AS MATERIALIZED (SELECT node, ts::DATE AS day, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT node, median(n) AS med, mad(n) AS d, count(*) AS days FROM g GROUP BY 1), k AS (SELECT median(n) AS cm, mad(n) AS cd FROM g),
p AS (SELECT node, day, n AS peak, row_number() OVER (PARTITION BY node ORDER BY n DESC, day) AS r FROM g),
j AS (SELECT p.node, day, peak, days < 5 AS fallback, CASE WHEN days >= 5 THEN med ELSE cm END AS med, CASE WHEN days >= 5 THEN d ELSE cd END AS d FROM p JOIN m USING (node), k WHERE r = 1 AND peak >= 8),
z AS (SELECT *, CASE WHEN d = 0 THEN (peak - med) / greatest(1, abs(med)) ELSE 0.6745::DOUBLE * (peak - med) / d END AS z FROM j)
SELECT node, day, node || '|' || strftime(day, '%Y-%m-%d') AS refs, peak, round(z, 6) AS z, fallback, round(greatest(0, least(1, 0.4::DOUBLE + 0.08::DOUBLE * z)), 6) AS score FROM z WHERE z >= 3.5""")
def a2_volume_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detect.volume_spike(domain.contacts(spark, sf_dir)).select("node", "day", refs(), "peak", "z", "fallback", "score"), "z", "score")


def _expansion_sql(relation: str) -> str:
    return f"""
WITH e AS ({relation}), b AS ({ENDS.format('ts')}), s AS MATERIALIZED (SELECT node, peer, min(ts) AS t FROM b GROUP BY ALL),
l AS MATERIALIZED (SELECT node, max(t) AS latest, min(t) AS earliest, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT n, floor((epoch_us(latest) - epoch_us(earliest)) / 86400000000.0) AS days FROM l WHERE n >= 2), k AS (SELECT median(n / greatest(1.0, (CASE WHEN days = 0 THEN 1 ELSE days END) / 7.0::DOUBLE)) AS rate FROM d),
g AS (SELECT s.node, latest - INTERVAL 7 DAY AS cut, earliest, count(*) FILTER (t >= latest - INTERVAL 7 DAY) AS fresh, count(*) FILTER (t < latest - INTERVAL 7 DAY) AS before FROM s JOIN l USING (node) GROUP BY ALL),
h AS (SELECT *, floor((epoch_us(cut) - epoch_us(earliest)) / 86400000000.0) AS days FROM g WHERE fresh >= 5),
y AS (SELECT node, fresh, before < 2 AS fallback, greatest(0.5, CASE WHEN before >= 2 THEN before / greatest(1.0, (CASE WHEN days = 0 THEN 1 ELSE days END) / 7.0::DOUBLE) ELSE coalesce(rate, 1.0) END) AS typical FROM h, k)
SELECT node, node || '|new-7d' AS refs, fresh, round(typical, 6) AS typical, fallback, round(least(1.0, 0.4::DOUBLE + 0.06::DOUBLE * fresh + 0.02::DOUBLE * (fresh / typical)), 6) AS score FROM y WHERE fresh >= 3.0 * typical"""


@query(_expansion_sql(PURCHASES))
def a3_counterparty_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detect.counterparty_expansion(domain.purchases(spark, sf_dir)).select("node", refs(), "fresh", "typical", "fallback", "score"), "typical", "score")


@query(f"""
WITH e AS (SELECT * FROM ({CONTACTS}) WHERE source_id <> target_id), b AS ({ENDS.format('ts')}),
g AS (SELECT node, count(*) AS total, count(*) FILTER (hour(ts) < 5) AS odd FROM b GROUP BY 1), k AS (SELECT sum(odd)::DOUBLE / sum(total) AS case_ratio FROM g),
j AS (SELECT *, odd::DOUBLE / total AS ratio FROM g, k WHERE total >= 8)
SELECT node, node || '|odd-hour' AS refs, odd, total, round(ratio, 6) AS ratio, round(case_ratio, 6) AS case_ratio, round(least(1.0, 0.4::DOUBLE + 0.1::DOUBLE * (CASE WHEN case_ratio <= 0 THEN ratio * 10 ELSE ratio / greatest(case_ratio, 0.02) END)), 6) AS score
FROM j WHERE ratio >= 0.25 AND (ratio >= 1.2::DOUBLE * greatest(case_ratio, 0.01) OR ratio >= 0.5)""")
def a4_odd_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detect.odd_hour(domain.contacts(spark, sf_dir), TUNED).select("node", refs(), "odd", "total", "ratio", "case_ratio", "score"), "ratio", "case_ratio", "score")


# ---------------------------------------------------------------- rule detectors


def _cycles_sql(longest: int, days: int) -> str:
    parts = []
    for k in range(3, longest + 1):
        names = [f"e{i}" for i in range(k)]
        lo, hi = f"least({', '.join(n + '.ts' for n in names)})", f"greatest({', '.join(n + '.ts' for n in names)})"
        joins = " ".join(f"JOIN e e{i} ON e{i}.source_id = e{i - 1}.target_id AND e{i}.source_id > e0.source_id" + "".join(f" AND e{i}.source_id <> e{j}.source_id" for j in range(1, i)) + (" AND e%d.target_id = e0.source_id" % i if i == k - 1 else "") + f" AND abs(epoch_us(e{i}.ts) - epoch_us(e0.ts)) < {(days + 1) * 86_400_000_000}" for i in range(1, k))
        parts.append(f"SELECT list_sort([{', '.join(n + '.source_id' for n in names)}]) AS ids, [{', '.join(n + '.id' for n in names)}] AS legs, {lo} AS low, {hi} AS high FROM e e0 {joins} WHERE floor((epoch_us({hi}) - epoch_us({lo})) / 86400000000.0) <= {days}")
    return " UNION ALL ".join(parts)


@query(f"""
WITH e AS MATERIALIZED ({TRADE}), c AS MATERIALIZED ({_cycles_sql(5, 30)}),
r AS (SELECT *, count(*) OVER (PARTITION BY ids) AS instances, row_number() OVER (PARTITION BY ids ORDER BY array_to_string(legs, ','), low, high) AS k FROM c)
SELECT array_to_string(ids, '|') AS entity_ids, len(ids)::INTEGER AS length, floor((epoch_us(high) - epoch_us(low)) / 86400000000.0)::BIGINT AS span_days, array_to_string(legs, ',') AS legs, array_to_string(legs, ',') AS refs, instances, round(least(1.0, 0.7::DOUBLE + 0.1::DOUBLE * len(ids)), 6) AS score FROM r WHERE k = 1""")
def p1_circular_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.circular_flow(domain.trade(spark, sf_dir))
    return r6(out.select(F.array_join("entity_ids", "|").alias("entity_ids"), "length", "span_days", F.array_join("legs", ",").alias("legs"), refs(), "instances", "score"), "score")


@query(f"""
WITH e AS (SELECT * FROM ({CONTACTS}) WHERE source_id <> target_id), b AS ({ENDS.format('ts')}),
g AS (SELECT node, count(DISTINCT peer) AS peers, string_agg(DISTINCT peer, ',' ORDER BY peer) AS refs, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0)::BIGINT AS span_days FROM b GROUP BY 1)
SELECT node, refs, node || '|' || replace(refs, ',', '|') AS entity_ids, peers, span_days, round(least(1.0, 0.6::DOUBLE + 0.08::DOUBLE * peers), 6) AS score FROM g WHERE peers >= 45 AND span_days <= 45""")
def p2_burner_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detect.burner_hub(domain.contacts(spark, sf_dir), TUNED).select("node", refs(), F.array_join("entity_ids", "|").alias("entity_ids"), "peers", "span_days", "score"), "score")


@query("""
WITH c AS (SELECT 'U' || user_id AS u, epoch_us(ts) AS m, 'E' || lpad(event_id::VARCHAR, 12, '0') AS id FROM events WHERE event_type = 'click'), t AS (SELECT 'U' || user_id AS u, epoch_us(ts) AS m, 'E' || lpad(event_id::VARCHAR, 12, '0') AS id FROM events WHERE event_type = 'purchase'),
j AS (SELECT c.u, c.m, c.id || ',' || t.id AS pair, t.m AS n FROM c ASOF JOIN t ON c.u = t.u AND c.m < t.m), g AS (SELECT u, count(*) AS hits, string_agg(pair, ',' ORDER BY m, pair) AS refs, min(n - m) / 3600000000.0::DOUBLE AS gap FROM j WHERE n - m <= 6 * 3600000000 GROUP BY 1)
SELECT 'DESK' AS a, u AS b, refs, hits, round(gap, 6) AS least_gap_hours, round(least(1.0, 0.4::DOUBLE + 0.15::DOUBLE * hits), 6) AS score FROM g WHERE hits >= 3""")
def p3_call_then_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detect.call_then_transfer(domain.desk_events(spark, sf_dir), TUNED).select("a", "b", refs(), "hits", "least_gap_hours", "score"), "least_gap_hours", "score")


@query("""
WITH g AS (SELECT 'U' || user_id AS u, ts::DATE AS day, count(*)::INTEGER AS n FROM events WHERE event_type = 'click' GROUP BY ALL),
p AS MATERIALIZED (SELECT u, list(day ORDER BY day) AS days, list(n ORDER BY day) AS ns FROM g GROUP BY 1 HAVING count(*) > 7),
w AS (SELECT u, i, days, ns, CASE WHEN i = 0 THEN ns[1:1] ELSE ns[1:i] END AS base FROM (SELECT *, unnest(range(0, len(days) - 6)) AS i FROM p)),
m AS (SELECT *, list_aggregate(base, 'median')::DOUBLE AS med FROM w), d AS (SELECT *, list_aggregate(list_transform(base, lambda x: abs(x - med)), 'median')::DOUBLE AS mad FROM m),
x AS (SELECT u, i, base, med, mad, days[j] AS day, ns[j] AS calls FROM (SELECT *, unnest(range(i + 1, i + 8)) AS j FROM d)),
z AS (SELECT *, CASE WHEN mad = 0 THEN (calls - med) / greatest(1.0, abs(med)) ELSE 0.6745::DOUBLE * (calls - med) / mad END AS z FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY z DESC, i, day) AS r FROM z WHERE z >= 2.0 AND NOT (len(list_distinct(base)) <= 1 AND calls <= base[1] + 1))
SELECT 'DESK' AS a, u AS b, day, 'DESK|' || u || '|' || strftime(day, '%Y-%m-%d') AS refs, calls, round(z, 6) AS z, round(calls / CASE WHEN med = 0 THEN 1.0 ELSE med END, 6) AS times, round(least(1.0, 0.5::DOUBLE + 0.05::DOUBLE * z), 6) AS score FROM k WHERE r = 1""")
def p4_comm_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detect.comm_burst(domain.desk_events(spark, sf_dir), TUNED).select("a", "b", "day", refs(), "calls", "z", "times", "score"), "z", "times", "score")


def _scan_sql() -> str:
    parts = [f"SELECT '{rule}' AS rule_id, node AS entities, refs, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM ({sql})" for rule, sql in (
        ("A2_volume_spike", ORACLE_SQL["a2_volume_spike"]), ("A3_counterparty_expansion", _expansion_sql(f"SELECT * FROM ({CONTACTS}) WHERE source_id <> target_id")), ("A4_odd_hour_activity", ORACLE_SQL["a4_odd_hour"]),
    )]
    return f"SELECT 'CASE-1:' || rule_id || ':' || substr(sha256(entities), 1, 16) AS id, * FROM ({' UNION ALL '.join(parts)})"


@query(_scan_sql())
def scan_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over the graph of contacts, less what is stored already (here: the
    findings of P2). It holds no transfer and few days of any pair, so P1, P3, A1 and, at the
    default, P4 find nothing in it."""
    e = domain.contacts(spark, sf_dir)
    found = detect.scan(e, replace(TUNED, burst_z=4.0))
    fresh = detect.new_findings(found, found.where("rule_id = 'P2_burner_hub'"))
    return r6(fresh.select("id", "rule_id", F.array_join("entity_ids", "|").alias("entities"), refs(), "severity", "score"), "score")


# ---------------------------------------------------------------- graph


@query(f"""
WITH e AS ({TRADE}), r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY id DESC) AS k FROM e) SELECT source_id, target_id, id, conf AS confidence_score FROM r WHERE k = 1""")
def g1_simple_digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.simple_digraph(domain.trade(spark, sf_dir)).select("source_id", "target_id", "id", "confidence_score")


def _pagerank_sql(steps: int) -> str:
    out = ["r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM v, c)"]
    for k in range(steps):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT v.node, 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE node NOT IN (SELECT source_id FROM t)) / n) + 0.15::DOUBLE / n AS r FROM v CROSS JOIN c LEFT JOIN (SELECT target_id, sum(r * w) AS g FROM r{k} JOIN s ON source_id = node GROUP BY 1) q ON q.target_id = v.node)")
    return ", ".join(out) + f" SELECT node AS id, round(r, 6) AS pagerank FROM r{steps}"


@query(f"""
WITH e AS ({TRADE}), d AS MATERIALIZED (SELECT source_id, target_id, max_by(conf, id) AS conf FROM e GROUP BY 1, 2), t AS MATERIALIZED (SELECT source_id, sum(conf) AS total FROM d GROUP BY 1), s AS MATERIALIZED (SELECT d.source_id, target_id, conf / total AS w FROM d JOIN t USING (source_id)),
v AS MATERIALIZED (SELECT source_id AS node FROM d UNION SELECT target_id FROM d), c AS (SELECT count(*)::DOUBLE AS n FROM v), {_pagerank_sql(20)}""")
def g2_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges.simple_digraph(domain.trade(spark, sf_dir))
    v = e.select("case_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return r6(graph.pagerank(v, e, iterations=20, tolerance=None).select("id", "pagerank"), "pagerank")


DIGRAPH = f"SELECT source_id AS s, target_id AS t, max_by(conf, id) AS w FROM ({TRADE}) GROUP BY 1, 2"


def _between_sql(hops: int) -> str:
    """Ties of shortest paths by whole paths of up to so many hops, which reach every node of
    this dense graph."""
    paths = ["SELECT s, t, w, []::VARCHAR[] AS inner_nodes FROM d"]
    for k in range(2, hops + 1):
        cols = ", ".join(f"d{i}.t" for i in range(1, k))
        joins = " ".join(f"JOIN d d{i} ON d{i}.s = d{i - 1}.t" for i in range(2, k + 1))
        paths.append(f"SELECT d1.s, d{k}.t, {' + '.join(f'd{i}.w' for i in range(1, k + 1))}, [{cols}] FROM d d1 {joins} WHERE d1.s <> d{k}.t")
    return f"""WITH d AS MATERIALIZED ({DIGRAPH}), v AS MATERIALIZED (SELECT s AS id FROM d UNION SELECT t FROM d), n AS (SELECT count(*)::DOUBLE AS n FROM v),
p AS MATERIALIZED ({' UNION ALL '.join(paths)}), m AS (SELECT s, t, min(round(w, 9)) AS best FROM p GROUP BY ALL), k AS MATERIALIZED (SELECT p.* FROM p JOIN m USING (s, t) WHERE round(w, 9) = best),
c AS (SELECT s, t, count(*) AS ways FROM k GROUP BY ALL), x AS (SELECT unnest(inner_nodes) AS id, 1.0::DOUBLE / ways AS part FROM k JOIN c USING (s, t)), y AS (SELECT id, sum(part) AS x FROM x GROUP BY 1)
SELECT v.id, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM v CROSS JOIN n LEFT JOIN y USING (id)"""


@query(_between_sql(3))
def g3_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges.simple_digraph(domain.trade(spark, sf_dir))
    v = e.select("case_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return r6(graph.betweenness(v, e).select("id", "betweenness"), "betweenness")


def _loops_sql(longest: int) -> str:
    parts = []
    for k in range(2, longest + 1):
        joins = " ".join(f"JOIN d d{i} ON d{i}.s = d{i - 1}.t AND d{i}.s > d1.s" + "".join(f" AND d{i}.s <> d{j}.s" for j in range(2, i)) + (f" AND d{i}.t = d1.s" if i == k else "") for i in range(2, k + 1))
        parts.append(f"SELECT [{', '.join(f'd{i}.s' for i in range(1, k + 1))}] AS nodes FROM d d1 {joins}")
    return f"""WITH d AS MATERIALIZED ({DIGRAPH}), c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT array_to_string(nodes, '|') AS nodes, len(nodes)::INTEGER AS length, row_number() OVER (ORDER BY len(nodes), array_to_string(nodes, '|'))::INTEGER AS place FROM c) SELECT * FROM r WHERE place <= 25"""


@query(_loops_sql(5))
def g5_money_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.money_cycles(domain.trade(spark, sf_dir))
    return found.select(F.array_join("nodes", "|").alias("nodes"), F.size("nodes").alias("length"), "place")


@query(f"""
WITH e AS (SELECT * FROM ({CONTACTS}) WHERE source_id <> target_id), b AS ({ENDS.format('ts')}),
w AS (SELECT node, count(DISTINCT peer) OVER (PARTITION BY node ORDER BY ts RANGE BETWEEN INTERVAL 72 HOURS PRECEDING AND CURRENT ROW) AS k FROM b)
SELECT node, max(k) AS call_degree, 72::INTEGER AS window_hours FROM w GROUP BY 1 HAVING max(k) >= 5""")
def g6_burner_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.burner_clusters(domain.contacts(spark, sf_dir)).select("node", "call_degree", "window_hours")


@query(f"""
WITH r AS (SELECT id, round_even(pagerank, 4) AS pagerank FROM ({ORACLE_SQL['g2_pagerank'].replace('round(r, 6)', 'r')})), b AS (SELECT id, round_even(betweenness, 4) AS betweenness FROM ({_between_sql(3).replace(', 6) AS betweenness', ', 12) AS betweenness')})),
c AS (SELECT id, count(*) AS cycles FROM (SELECT unnest(string_split(nodes, '|')) AS id FROM ({_loops_sql(5)})) GROUP BY 1), n AS (SELECT count(*) AS n FROM r)
SELECT r.id, pagerank, betweenness, coalesce(cycles, 0) AS cycles, false AS burner_flag,
 round_even(greatest(5.0::DOUBLE, least(95.0::DOUBLE, 20 + pagerank * n * 40 + betweenness * 20 + 10 * least(coalesce(cycles, 0), 2))), 1) AS computed_base_risk
FROM r JOIN b USING (id) LEFT JOIN c USING (id) CROSS JOIN n""")
def g8_entity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.trade(spark, sf_dir)
    nodes = e.select("case_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return graph.entity_signals(nodes, e, iterations=20).select("id", "pagerank", "betweenness", "cycles", "burner_flag", "computed_base_risk")


# ---------------------------------------------------------------- risk, overview, masks


@query(f"""
WITH e AS ({PURCHASES}), g AS (SELECT source_id AS id, count(*) AS links FROM e GROUP BY 1), p AS (SELECT 'C' || c_custkey AS id, least(95.0, greatest(5.0, round_even(abs(c_acctbal) / 100, 1))) AS base FROM customer),
j AS (SELECT p.id, CASE WHEN coalesce(links, 0) = 0 THEN 1 ELSE 5 END AS l, CASE WHEN base >= 80 THEN 5 WHEN base >= 60 THEN 4 WHEN base >= 40 THEN 3 ELSE 1 END AS c FROM p LEFT JOIN g USING (id)),
t AS (SELECT *, CASE WHEN l = 5 THEN CASE WHEN c >= 4 THEN 'VERY HIGH' WHEN c >= 2 THEN 'HIGH' ELSE 'MEDIUM' END ELSE CASE WHEN c >= 3 THEN 'LOW' ELSE 'VERY LOW' END END AS tier FROM j)
SELECT id, l::INTEGER AS likelihood, c::INTEGER AS consequence, tier, (l + c) * 10.0::DOUBLE AS threat_score, CASE WHEN tier LIKE '%HIGH' THEN 'HIGH' WHEN tier = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM t""")
def k3_threat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.threat_scores(domain.people(spark, sf_dir), domain.purchases(spark, sf_dir)).select("id", "likelihood", "consequence", "tier", "threat_score", "risk_level")


@query("SELECT 'CASE-1' AS case_id, count(*) FILTER (c_mktsegment <> 'BUILDING') AS suspects, count(*) AS phones, count(*) FILTER (c_mktsegment = 'BUILDING') AS accounts FROM customer")
def a0_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.overview(domain.people(spark, sf_dir))


@query("""SELECT 'C' || c_custkey AS id, substr(c_name, 1, 1) || '***' AS name, '+91-******' || right('+91-9' || lpad(c_custkey::VARCHAR, 9, '0'), 2) AS phone FROM customer""")
def f15_masked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.masked(domain.people(spark, sf_dir), "analyst").select("id", "name", F.get("phone_numbers", F.lit(0)).alias("phone"))


# ---------------------------------------------------------------- ledger


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events")
    return audit.build_chain(e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("actor_id"), F.col("event_type").alias("action"), F.lit(domain.CASE).alias("case_id")))


@query("""
WITH RECURSIVE l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) AS k, event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|U' || user_id || '|' || event_type || '|CASE-1|' AS t FROM events),
c AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, repeat('0', 64) AS h UNION ALL SELECT l.k, l.id, sha256(l.t || c.h) FROM c JOIN l ON l.k = c.k + 1)
SELECT id, h AS current_hash FROM c WHERE k > 0""")
def l1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("id", "current_hash")


@query("SELECT true AS verified, count(*) AS entries FROM events")
def l2_verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.is_intact(ledger(spark, sf_dir))


@query("SELECT 'APPENDED_SINCE_ANCHOR' AS status, count(*) // 2 AS behind_by FROM events")
def l4_verify_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger against an anchor taken at its middle."""
    chain = ledger(spark, sf_dir)
    total = chain.count()
    middle = total - total // 2
    order = chain.orderBy("id").limit(middle)
    return audit.verify_anchor(chain, audit.head_of(order))


# ---------------------------------------------------------------- text, keys, state


@query("""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:\\+?91[\\s\\-]?)?[6-9]\\d{4}[\\s\\-]?\\d{5}')) AS found FROM documents)
SELECT doc_id, found, '+91-' || right(regexp_replace(found, '[^0-9]', '', 'g'), 10) AS phone FROM d""")
def e1_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domain.table(spark, sf_dir, "documents").select("doc_id", F.explode(S.find_all("text", S.PHONE)).alias("found"))
    return d.select("doc_id", "found", S.loose_phone("found").alias("phone"))


def _spans_sql() -> str:
    """Matches with their places: what lies before a match is the pieces between matches and
    the matches so far. Letters beyond ASCII stand as one of the word characters."""
    kinds = (("phone", S.PHONE), ("vehicle", S.VEHICLE), ("person", S.NAME))
    found = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS kind, regexp_extract_all(u, '{p}') AS ms, string_split_regex(u, '{p}') AS ss FROM d" for k, p in kinds)
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g') AS u FROM documents), p AS ({found}),
x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM p),
y AS (SELECT doc_id, t, kind, length(ms[i]) AS n, (list_sum(list_transform(ss[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: length(s))), 0))::INTEGER AS a FROM x),
z AS (SELECT doc_id, kind, substr(t, a + 1, n) AS text, a, (a + n)::INTEGER AS b, regexp_replace(substr(t, a + 1, n), '[^0-9]', '', 'g') AS g FROM y),
w AS (SELECT *, CASE WHEN length(g) = 12 AND g LIKE '91%' THEN substr(g, 3) WHEN length(g) = 11 AND g LIKE '0%' THEN substr(g, 2) ELSE g END AS h FROM z)
SELECT doc_id, kind AS entity_type, text, a AS span_start, b AS span_end, CASE kind WHEN 'phone' THEN 0.98 WHEN 'vehicle' THEN 0.97 ELSE 0.55 END::DOUBLE AS confidence
FROM w WHERE kind <> 'phone' OR length(h) = 10 AND h[1] IN ('6', '7', '8', '9')"""


@query(_spans_sql())
def e4_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extract import extract

    d = extract(domain.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode("found").alias("e")).select("doc_id", "e.*")


@query()
def e5_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extract import extract, relations

    return relations(extract(domain.table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").drop("evidence")


@query("""
SELECT substr(sha256(coalesce(text, '')), 1, 16) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def x12_content_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "documents").groupBy(S.content_hash("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
SELECT c_custkey, '9' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '0') AS phone, 'DL01AB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS vehicle, replace(lower(c_name), '.', ' ') AS name,
 substr(sha256('C' || c_custkey || '|N' || c_nationkey), 1, 16) AS set_hash, '₹' || format('{:,}', round_even(c_acctbal, 0)::BIGINT) AS balance FROM customer""")
def x1_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    raw = F.format_string("+91-9%04d %05d", ((key / 100000).cast("int") % 10000).cast("int"), (key % 100000).cast("int"))
    return c.select("c_custkey", S.normalize_phone(raw).alias("phone"), S.normalize_vehicle(F.format_string("dl-01_ab %04d", (key % 10000).cast("int"))).alias("vehicle"), S.normalize_name(F.concat(F.lit("Shri "), "c_name")).alias("name"), S.set_hash(F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.concat(F.lit("C"), key.cast("string")))).alias("set_hash"), S.fmt_inr("c_acctbal").alias("balance"))


@query("""
WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1""")
def sk1_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after all events are upserted by user and type."""
    e = domain.table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    return state.upsert(e.limit(0), e, ["user_id", "event_type"], order="at").select("user_id", "event_type", "event_id", "value")


@query("""
SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS amount, ts AS event_ts, event_type LIKE '%view%' AS viewed FROM events""")
def f4_event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and amounts parsed from evidence details, as an edge carries them."""
    e = domain.table(spark, sf_dir, "events")
    detail = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.get_json_object("props", "$.k").alias("amount")))
    return e.select("event_id", edges.amount_of(F.lit(""), detail).alias("amount"), S.parse_ts(F.get_json_object(detail, "$.timestamp")).alias("event_ts"), edges.has_word(F.col("event_type"), ("VIEW",)).alias("viewed"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.amount_outlier(domain.purchases(spark, sf_dir), Detection(amount_z=2.5))
