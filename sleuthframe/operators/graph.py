"""Graph analytics over vertices(case_id, id) and edges of any number of cases at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch
from .edges import both_ends, is_call, is_txn, micros, simple_digraph


def build_graph(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): parallel edges collapse, and ends without an entity are vertices."""
    e = simple_digraph(edges)
    ends = e.select("case_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    return entities.select("case_id", "id").unionByName(ends).distinct(), e


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Weighted power iteration with the mass of dead ends spread evenly; all cases together.
    Each step is a written table: it is read thrice by the next, so lineage would grow with a
    power of the steps. ``tolerance`` None runs all iterations."""
    scratch = Scratch(vertices.sparkSession, "pagerank")
    n = vertices.groupBy("case_id").agg(F.count("*").alias("n"))
    total = edges.groupBy("case_id", "source_id").agg(F.sum("confidence_score").alias("total")).where("total > 0")
    share = scratch.save(edges.join(total, ["case_id", "source_id"]).select("case_id", F.col("source_id").alias("id"), F.col("target_id").alias("to"), (F.col("confidence_score") / F.col("total")).alias("w")), "share")
    dead = vertices.join(share.select("case_id", "id").distinct().withColumn("live", F.lit(True)), ["case_id", "id"], "left").join(n, "case_id")
    base = scratch.save(dead.select("case_id", "id", "n", F.col("live").isNull().alias("dead")), "base")
    rank = base.withColumn("r", 1.0 / F.col("n"))
    for k in range(iterations):
        sent = rank.join(share, ["case_id", "id"]).groupBy("case_id", F.col("to").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("got"))
        lost = rank.groupBy("case_id").agg(F.sum(F.when(F.col("dead"), F.col("r")).otherwise(0.0)).alias("lost"))
        was = rank.withColumnRenamed("r", "was")
        rank = was.join(sent, ["case_id", "id"], "left").join(lost, "case_id").withColumn("r", damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - damping) / F.col("n")).select("case_id", "id", "n", "dead", "r", "was")
        rank = scratch.save(rank, f"rank-{k}")
        if tolerance is not None and k % 5 == 4:
            if not rank.groupBy("case_id").agg(F.sum(F.abs(F.col("r") - F.col("was"))).alias("moved"), F.first("n").alias("n")).where(F.col("moved") >= F.col("n") * tolerance).limit(1).count():
                break
        rank = rank.drop("was")
    return rank.select("case_id", "id", F.col("r").alias("pagerank"))


def dependencies(arcs: dict, source) -> dict:
    """Shortest-path dependencies of all nodes on one source (distances are positive)."""
    import heapq

    dist, paths, before, order = {}, {source: 1}, {source: []}, []
    best, heap, tick = {source: 0.0}, [(0.0, 0, source)], 0
    while heap:
        d, _, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = d
        order.append(v)
        for w, length in arcs.get(v, ()):
            far = d + length
            if w not in dist and (w not in best or far < best[w] - 1e-15):
                best[w], paths[w], before[w] = far, 0, []
                tick += 1
                heapq.heappush(heap, (far, tick, w))
            if w not in dist and abs(far - best[w]) <= 1e-15 and v not in before[w]:
                paths[w] += paths[v]
                before[w].append(v)
    out: dict = {}
    for w in reversed(order):
        for v in before[w]:
            out[v] = out.get(v, 0.0) + paths[v] / paths[w] * (1 + out.get(w, 0.0))
    out.pop(source, None)
    return out


def betweenness(vertices: DataFrame, edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """Normalised weighted betweenness (a link's confidence is its length).

    Sources are dealt over the tasks. Every task needs the case graph, so it is broadcast
    within a checked bound; above it the caller must split by case."""
    spark = vertices.sparkSession
    count = edges.count()
    if count > most_edges:
        raise ValueError(f"{count} edges exceed the bound of {most_edges} for an in-memory graph")
    graph: dict = {}
    for c, s, t, w in edges.select("case_id", "source_id", "target_id", F.col("confidence_score").cast("double")).collect():
        graph.setdefault(c, {}).setdefault(s, []).append((t, w if w is not None else 1.0))
    sent = spark.sparkContext.broadcast(graph)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for part in parts:
            for c, s in zip(part.case_id, part.id, strict=True):
                for v, x in dependencies(sent.value.get(c, {}), s).items():
                    total[c, v] = total.get((c, v), 0.0) + x
        yield pd.DataFrame([(c, v, x) for (c, v), x in total.items()], columns=["case_id", "id", "x"])

    sums = vertices.repartition("case_id", "id").mapInPandas(run, "case_id string, id string, x double").groupBy("case_id", "id").agg(F.sum("x").alias("x"))
    n = vertices.groupBy("case_id").agg(F.count("*").alias("n"))
    return vertices.join(sums, ["case_id", "id"], "left").join(n, "case_id").select("case_id", "id", F.when(F.col("n") > 2, F.coalesce("x", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))


def simple_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """All directed simple cycles up to a length, each from its least node."""
    hop = edges.select("case_id", F.col("source_id").alias("last"), F.col("target_id").alias("next"))
    loops = hop.where("last = next").select("case_id", F.array("last").alias("nodes"))
    paths = hop.where("last < next").select("case_id", F.array("last", "next").alias("nodes"), F.col("next").alias("last"))
    out = loops
    for size in range(2, longest + 1):
        step = paths.join(hop, ["case_id", "last"]).where(F.col("next") >= F.col("nodes")[0])
        out = out.unionByName(step.where(F.col("next") == F.col("nodes")[0]).select("case_id", "nodes"))
        if size < longest:
            paths = step.where(~F.array_contains("nodes", F.col("next"))).select("case_id", F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("last"))
    return out


def money_cycles(edges: DataFrame, longest: int = 5, most: int = 25) -> DataFrame:
    """The shortest cycles of the transfer graph of each case (a report of ``most``)."""
    found = simple_cycles(simple_digraph(edges).where(is_txn("relation_type")), longest)
    order = W.partitionBy("case_id").orderBy(F.size("nodes"), F.array_join("nodes", "|"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def burner_clusters(edges: DataFrame, peers: int = 5, hours: int = 72) -> DataFrame:
    """Nodes that call many parties within a trailing window. Nodes with too few parties in
    all are dropped before the window runs."""
    ends = both_ends(edges.where(is_call("relation_type", graph=True))).select("case_id", "node", "peer", "ts")
    able = ends.groupBy("case_id", "node").agg(F.count_distinct("peer").alias("all_peers"), F.count("ts").alias("dated")).where(F.col("all_peers") >= peers)
    trail = W.partitionBy("case_id", "node").orderBy("m").rangeBetween(-hours * 3_600_000_000, 0)
    dated = ends.where("ts is not null").join(able.select("case_id", "node"), ["case_id", "node"]).withColumn("m", micros("ts"))
    best = dated.withColumn("k", F.size(F.collect_set("peer").over(trail))).groupBy("case_id", "node").agg(F.max("k").alias("k"))
    out = able.join(best, ["case_id", "node"], "left").withColumn("call_degree", F.when(F.col("dated") == 0, F.col("all_peers")).otherwise(F.coalesce("k", F.lit(0))))
    return out.where(F.col("call_degree") >= peers).select("case_id", "node", F.col("call_degree").cast("bigint").alias("call_degree"), F.lit(hours).alias("window_hours"), F.format_string("%d distinct contacts within %d hours", "call_degree", F.lit(hours)).alias("reason"))


def base_risk(pagerank, n, betweenness, cycles, burner):
    """0-100 base risk of a node from its signals, one decimal."""
    c = S._c
    raw = 20 + c(pagerank) * c(n) * 40 + c(betweenness) * 20 + 10 * F.least(c(cycles), F.lit(2)) + F.when(c(burner), 15).otherwise(0)
    return F.bround(S.clamp(raw, 5.0, 95.0), 1)


def entity_signals(entities: DataFrame, edges: DataFrame, iterations: int = 100) -> DataFrame:
    """Every signal of every node, each computed once."""
    vertices, g = build_graph(entities, edges)
    rank = pagerank(vertices, g, iterations=iterations).withColumn("pagerank", F.bround("pagerank", 4))
    between = betweenness(vertices, g).withColumn("betweenness", F.bround("betweenness", 4))
    loops = money_cycles(edges).select("case_id", F.explode("nodes").alias("id")).groupBy("case_id", "id").agg(F.count("*").alias("cycles"))
    burners = burner_clusters(edges).select("case_id", F.col("node").alias("id"), "call_degree", F.col("reason").alias("burner_reason"))
    n = vertices.groupBy("case_id").agg(F.count("*").alias("n"))
    keys = ["case_id", "id"]
    out = rank.join(between, keys).join(loops, keys, "left").join(burners, keys, "left").join(n, "case_id").na.fill(0, ["cycles"])
    out = out.withColumns({"in_money_cycle": F.col("cycles") > 0, "burner_flag": F.col("call_degree").isNotNull()})
    return out.withColumn("computed_base_risk", base_risk("pagerank", "n", "betweenness", "cycles", "burner_flag"))


def recompute_base_risk(entities: DataFrame, signals: DataFrame) -> DataFrame:
    new = signals.select("case_id", "id", F.col("computed_base_risk").alias("_r"))
    return entities.join(new, ["case_id", "id"], "left").withColumn("base_risk_score", F.coalesce("_r", "base_risk_score")).drop("_r")


def graph_analytics(entities: DataFrame, edges: DataFrame, iterations: int = 100) -> dict[str, DataFrame]:
    """The bundle of a case's graph: counts, signals, money cycles and burner clusters, each
    computed once."""
    vertices, g = build_graph(entities, edges)
    counts = vertices.groupBy("case_id").agg(F.count("*").alias("nodes")).join(g.groupBy("case_id").agg(F.count("*").alias("links")), "case_id", "left").na.fill(0, ["links"])
    return {"counts": counts, "signals": entity_signals(entities, edges, iterations), "cycles": money_cycles(edges), "burners": burner_clusters(edges)}
