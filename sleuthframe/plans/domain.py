"""The analytics' relations from the star schema: calls, contacts, transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import is_call, is_txn

CASE = "CASE-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(e: DataFrame) -> DataFrame:
    e = e.where("source_id <> target_id")
    return e.select(F.lit(CASE).alias("case_id"), "id", "source_id", "target_id", "relation_type", "confidence_score", "ts", "amount", is_call("relation_type").alias("is_call"), is_txn("relation_type").alias("is_txn"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a call of its user to a user drawn from the event."""
    e = table(spark, sf_dir, "events")
    return _typed(e.select(F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_id"), F.concat(F.lit("U"), ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % 211).cast("string")).alias("target_id"), F.lit("CALLED").alias("relation_type"), (0.5 + F.col("event_id") % 50 / 100.0).alias("confidence_score"), "ts", F.lit(None).cast("double").alias("amount")))


def desk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are calls and purchases transfers between a user and the desk."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase', 'view')")
    rel = F.when(F.col("event_type") == "purchase", "TRANSFER").when(F.col("event_type") == "click", "CALLED").otherwise("VIEWED")
    return _typed(e.select(F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_id"), F.lit("DESK").alias("target_id"), rel.alias("relation_type"), F.lit(0.9).alias("confidence_score"), "ts", F.col("value").alias("amount")))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines are transfers of customers to suppliers."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _typed(rows.select(F.format_string("L%012d-%02d", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("TRANSFER").alias("relation_type"), F.lit(0.88).alias("confidence_score"), F.col("o_orderdate").alias("ts"), F.col("l_extendedprice").alias("amount")))


def trade(spark: SparkSession, sf_dir: str, quantity: float = 48, discount: float = 0.09) -> DataFrame:
    """Large discounted order lines are transfers between nations: the cyclic graph."""
    li = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") >= quantity) & (F.col("l_discount") >= discount))
    rows = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _typed(rows.select(F.format_string("L%012d-%02d", "l_orderkey", "l_linenumber").alias("id"), F.format_string("N%02d", "c_nationkey").alias("source_id"), F.format_string("N%02d", "s_nationkey").alias("target_id"), F.lit("TRANSFER").alias("relation_type"), (0.5 + F.col("l_quantity") / 100.0).alias("confidence_score"), F.col("o_orderdate").alias("ts"), F.col("l_extendedprice").alias("amount")))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities with a phone made of their key."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.lit(CASE).alias("case_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.format_string("+91-9%09d", "c_custkey")).alias("phone_numbers"), F.when(F.col("c_mktsegment") == "BUILDING", "BANK_ACCOUNT").otherwise("PERSON").alias("entity_type"), F.least(F.lit(95.0), F.greatest(F.lit(5.0), F.bround(F.abs("c_acctbal") / 100, 1))).alias("base_risk_score"))
