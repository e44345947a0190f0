"""State as snapshots: upserts, first-wins inserts, properties, reviews. Plain Parquet knows no
MERGE, so every function returns the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Last wins, the new rows over the stored ones; aggregated, so a hot key costs no sort."""
    cols = stored.columns
    rows = stored.withColumn("_o", F.lit(0)).unionByName(new.select(*cols).withColumn("_o", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    rank = F.struct("_o", F.col(order) if order else F.lit(0), *[F.to_json(F.struct(*rest))] if rest else [])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in cols])


def upsert_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert, but aliases and phones are united, so that a re-ingest loses none."""
    merged = upsert(stored, new, ["case_id", "id"])
    both = stored.select("case_id", "id", "aliases", "phone_numbers").unionByName(new.select("case_id", "id", "aliases", "phone_numbers"))
    sets = both.groupBy("case_id", "id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"_{c}") for c in ("aliases", "phone_numbers")])
    return merged.join(sets, ["case_id", "id"]).withColumns({c: F.col(f"_{c}") for c in ("aliases", "phone_numbers")}).select(*stored.columns)


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert, but a decided review outlives a re-ingest. Ids default to source->target:RELATION."""
    new = new.withColumn("id", F.coalesce("id", F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "relation_type")))
    decided = stored.where(F.col("status").isin("APPROVE", "REJECT", "CONFIRMED")).select("case_id", "id", F.col("status").alias("_s"), F.col("reviewer").alias("_r"), F.col("reviewed_at").alias("_a"))
    out = upsert(stored, new, ["case_id", "id"]).join(decided, ["case_id", "id"], "left")
    return out.withColumns({"status": F.coalesce("_s", "status"), "reviewer": F.coalesce("_r", "reviewer"), "reviewed_at": F.coalesce("_a", "reviewed_at")}).select(*stored.columns)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First wins: only keys that are not stored come in, once."""
    return stored.unionByName(new.select(*stored.columns).dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def properties(props: DataFrame) -> DataFrame:
    """Key-value rows (edge_id, key, value) as a map per edge."""
    one = props.groupBy("edge_id", "key").agg(F.max("value").alias("value"))
    return one.groupBy("edge_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))


def review_links(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Edges after reviews (id, verb, reviewer, reviewed_at); an unknown id changes nothing."""
    r = reviews.select("id", F.upper("verb").alias("_v"), F.col("reviewer").alias("_r"), F.col("reviewed_at").alias("_a"))
    return edges.join(r, "id", "left").withColumns({"status": F.coalesce("_v", "status"), "reviewer": F.coalesce("_r", "reviewer"), "reviewed_at": F.coalesce("_a", "reviewed_at")}).select(*edges.columns)


def pending_links(edges: DataFrame) -> DataFrame:
    return edges.where(F.upper("status").isin("PENDING", "PENDING_REVIEW", "UNREVIEWED"))


def masked(entities: DataFrame, role: str) -> DataFrame:
    """What a role may see: all for the lead investigator, else masked phones and names."""
    from ..functions import scalars as S

    if role == "lead_investigator":
        return entities
    return entities.withColumns({"phone_numbers": F.transform("phone_numbers", S.mask_phone), "name": S.mask_name("name"), "aliases": F.transform(F.coalesce("aliases", F.array().cast("array<string>")), S.mask_name)})


def overview(entities: DataFrame) -> DataFrame:
    """Counts of a case's suspects, phones and accounts."""
    kind = F.upper("entity_type")
    return entities.groupBy("case_id").agg(F.count_if(kind == "PERSON").alias("suspects"), F.sum(F.size(F.coalesce("phone_numbers", F.array().cast("array<string>")))).alias("phones"), F.count_if(kind == "BANK_ACCOUNT").alias("accounts"))


# ---------------------------------------------------------------- evidence, checks, tables

TABLES = {
    "cases": "id string, title string, description string, status string, created_at timestamp_ntz",
    "entities": "id string, case_id string, name string, aliases array<string>, phone_numbers array<string>, entity_type string, base_risk_score double",
    "edges": "id string, case_id string, source_id string, target_id string, relation_type string, confidence_score double, evidence_source string, status string, reviewer string, reviewed_at timestamp_ntz",
    "evidence_sources": "id bigint, edge_id string, source_type string, reference string, details string",
    "audit_log": "id bigint, timestamp string, actor_id string, action string, case_id string, previous_hash string, current_hash string",
    "merge_log": "id string, case_id string, surviving_entity_id string, merged_entity_ids array<string>, rule string, confidence double, decision string, decided_by string, created_at timestamp_ntz",
    "entity_sources": "entity_id string, case_id string, source_type string, record_id string, field string, span_start int, span_end int, confidence double",
    "extraction_runs": "run_key string, case_id string, source_type string, record_id string, content_hash string, created_at timestamp_ntz",
    "findings": "id string, case_id string, rule_id string, severity string, score double, entity_ids array<string>, entity_set_hash string, explanation string, evidence array<struct<edge_id:string,source_type:string,reference:string,detail:string>>, detected_at timestamp_ntz, status string",
    "edge_props": "edge_id string, key string, value string",
}


def bootstrap(spark, folder: str) -> list[str]:
    """Empty tables where the folder has none yet; those that were made."""
    made = []
    for name, kind in TABLES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made


def append_evidence(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Plain append (edge_id, source_type, reference, details), numbered after the stored; the
    numbers rise within a partition and have gaps."""
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    rows = new.withColumn("_k", F.monotonically_increasing_id()).crossJoin(F.broadcast(last))
    return stored.unionByName(rows.withColumn("id", F.col("_last") + 1 + F.col("_k")).select(*stored.columns))


def replace_evidence(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All evidence of the edges that ``new`` names gives way to it."""
    return append_evidence(stored.join(new.select("edge_id").distinct(), "edge_id", "left_anti").select(*stored.columns), new)


def checked(edges: DataFrame) -> DataFrame:
    """Edges whose confidence lies in [0, 1]; any other is an error when read."""
    fine = F.col("confidence_score").isNull() | F.col("confidence_score").between(0, 1)
    return edges.withColumn("confidence_score", F.when(fine, F.col("confidence_score")).otherwise(F.raise_error(F.concat(F.lit("confidence out of range: "), "id"))))


def graph_links(edges: DataFrame) -> DataFrame:
    """Edges as a drawn graph needs them."""
    return edges.select(F.col("id").alias("link_id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("label"), F.col("confidence_score").alias("confidence"), "status")


def ingest_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): what an ingest brought, by entity and relation type."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("entity_type").alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("relation_type").alias("name")).agg(F.count("*").alias("n")))


def entities_of(entities: DataFrame, case_id: str) -> DataFrame:
    return entities.where(F.col("case_id") == case_id).orderBy("id")


def edges_of(edges: DataFrame, case_id: str) -> DataFrame:
    return edges.where(F.col("case_id") == case_id).orderBy("id")
