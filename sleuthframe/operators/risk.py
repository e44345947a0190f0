"""Likelihood x consequence risk scoring of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .edges import both_ends

# Tiers by likelihood (rows 1-5) and consequence (columns 1-5).
MATRIX = (
    ("VERY LOW", "VERY LOW", "LOW", "LOW", "LOW"),
    ("VERY LOW", "LOW", "LOW", "MEDIUM", "MEDIUM"),
    ("LOW", "LOW", "MEDIUM", "HIGH", "HIGH"),
    ("LOW", "MEDIUM", "HIGH", "HIGH", "VERY HIGH"),
    ("MEDIUM", "HIGH", "HIGH", "VERY HIGH", "VERY HIGH"),
)


def likelihood(links, confidence, burner, cycle, betweenness) -> Column:
    n, c = S._c(links), S._c(confidence)
    base = F.when(n == 0, 1).when((n >= 5) | (c >= 0.85), 5).when((n >= 3) | (c >= 0.70), 4).when(n >= 2, 3).otherwise(2)
    boost = S._c(burner).cast("int") + S._c(cycle).cast("int") + (S._c(betweenness) >= 0.15).cast("int")
    return F.when(n == 0, F.lit(1)).otherwise(F.least(F.lit(5), base + boost))


def consequence(base_risk, suspicious) -> Column:
    b = S._c(base_risk)
    level = F.when(b >= 80, 5).when(b >= 60, 4).when(b >= 40, 3).otherwise(1)
    return F.least(F.lit(5), level + S._c(suspicious)).cast("int")


def tier(l: Column, c: Column) -> Column:
    table = F.array(*[F.lit(t) for row in MATRIX for t in row])
    return F.get(table, ((l - 1) * 5 + c - 1).cast("int"))


def threat_scores(entities: DataFrame, edges: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """One row per entity: likelihood, consequence, tier, score, level and factors."""
    links = both_ends(edges.select("case_id", "source_id", "target_id", "relation_type", "confidence_score")).groupBy("case_id", F.col("node").alias("id")).agg(F.count("*").alias("links"), F.avg("confidence_score").alias("confidence"), F.count_if(F.upper("relation_type").contains("SUSPICIOUS")).alias("suspicious"))
    out = entities.join(links, ["case_id", "id"], "left").na.fill(0, ["links", "suspicious"])
    if signals is None:
        out = out.withColumns({"burner_flag": F.lit(False), "in_money_cycle": F.lit(False), "betweenness": F.lit(0.0), "computed_base_risk": F.lit(None).cast("double")})
    else:
        out = out.join(signals.select("case_id", "id", "burner_flag", "in_money_cycle", "betweenness", "computed_base_risk"), ["case_id", "id"], "left").na.fill(False, ["burner_flag", "in_money_cycle"]).na.fill(0.0, ["betweenness"])
    out = out.withColumns({"likelihood": likelihood("links", "confidence", "burner_flag", "in_money_cycle", "betweenness"), "consequence": consequence(F.coalesce("computed_base_risk", "base_risk_score"), "suspicious")})
    out = out.withColumn("tier", tier(F.col("likelihood"), F.col("consequence")))
    factors = F.array_compact(F.array(
        F.when(F.col("links") == 0, "no links"), F.when(F.col("links") > 0, F.format_string("likelihood %d/5 from %d links", "likelihood", "links")),
        F.when(F.col("burner_flag"), "burner contacts: +1 likelihood"), F.when(F.col("in_money_cycle"), "money cycle: +1 likelihood"), F.when(F.col("betweenness") >= 0.15, "broker position: +1 likelihood"),
        F.when(F.col("suspicious") > 0, F.format_string("raised by %d suspicious links", "suspicious")), F.format_string("consequence %d/5", "consequence"), F.format_string("matrix tier %s", "tier"),
    ))
    return out.select("case_id", "id", "likelihood", "consequence", "tier", F.bround((F.col("likelihood") + F.col("consequence")) * 10.0, 1).alias("threat_score"), F.when(F.col("tier").isin("HIGH", "VERY HIGH"), "HIGH").when(F.col("tier") == "MEDIUM", "MEDIUM").otherwise("LOW").alias("risk_level"), factors.alias("contributing_factors"))


def batch_scores(scores: DataFrame, ids: list[str], most: int = 200) -> DataFrame:
    """The scores of up to ``most`` asked ids; unknown ones are passed over."""
    if len(ids) > most:
        raise ValueError(f"at most {most} ids")
    return scores.where(F.col("id").isin(*ids))
