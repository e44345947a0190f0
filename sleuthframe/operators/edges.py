"""The enriched edge view: what every detector reads, parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CALL_WORDS, GRAPH_CALL_WORDS, TXN_WORDS
from ..functions import scalars as S


def has_word(relation: Column, words) -> Column:
    return F.upper(F.coalesce(relation, F.lit(""))).rlike("|".join(words))


def is_txn(relation) -> Column:
    return has_word(S._c(relation), TXN_WORDS)


def is_call(relation, graph: bool = False) -> Column:
    return has_word(S._c(relation), GRAPH_CALL_WORDS if graph else CALL_WORDS)


def event_ts(evidence: Column, details: Column) -> Column:
    """The time in the evidence text, else that of the details. A review's time is no event."""
    blob = F.concat_ws(" ", F.coalesce(evidence, F.lit("")), F.coalesce(details, F.lit("")))
    return F.coalesce(S.parse_ts(F.nullif(F.regexp_extract(blob, S.STAMP, 1), F.lit(""))), S.parse_ts(F.get_json_object(details, "$.timestamp")))


def amount_of(evidence: Column, details: Column) -> Column:
    keys = [F.get_json_object(details, f"$.{k}").try_cast("double") for k in ("amount", "amt", "value", "rs", "inr")]
    blob = F.concat_ws(" ", F.coalesce(evidence, F.lit("")), F.coalesce(details, F.lit("")))
    return F.coalesce(*keys, F.replace(F.regexp_extract(blob, S.RUPEES, 1), F.lit(","), F.lit("")).try_cast("double"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """One row per edge: that of the least id."""
    return evidence.groupBy("edge_id").agg(F.min_by("details", "id").alias("details"))


def enrich(edges: DataFrame, evidence: DataFrame | None = None, exclude_rejected: bool = False) -> DataFrame:
    """Edges with ts, amount, is_call and is_txn; self-loops are no events."""
    if evidence is not None:
        edges = edges.join(first_evidence(evidence).withColumnRenamed("edge_id", "id"), "id", "left")
    elif "details" not in edges.columns:
        edges = edges.withColumn("details", F.lit(None).cast("string"))
    if exclude_rejected:
        edges = edges.where(F.coalesce("status", F.lit("")) != "REJECT")
    return edges.where("source_id <> target_id").withColumns({"ts": event_ts(F.col("evidence_source"), F.col("details")), "amount": amount_of(F.col("evidence_source"), F.col("details")), "is_call": is_call("relation_type"), "is_txn": is_txn("relation_type")})


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge once per end: node, peer."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("peer")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("peer"))))
    return edges.withColumn("end", ends).select("*", "end.node", "end.peer").drop("end")


def incident(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges at the given nodes, by an equi-join on either end."""
    return both_ends(edges).join(nodes.select(F.col(key).alias("node")), "node", "left_semi")


def simple_digraph(edges: DataFrame) -> DataFrame:
    """One edge per direction: of parallel edges the one whose id sorts last."""
    return edges.groupBy("case_id", "source_id", "target_id").agg(F.max_by(F.struct("id", "relation_type", "confidence_score"), "id").alias("e")).select("case_id", "source_id", "target_id", "e.*")


def floor_days(low, high) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_micros(S._c(high).cast("timestamp")) - F.unix_micros(S._c(low).cast("timestamp"))) / F.lit(86_400_000_000))


def micros(ts) -> Column:
    return F.unix_micros(S._c(ts).cast("timestamp"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
