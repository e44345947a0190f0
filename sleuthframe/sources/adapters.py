"""Feeds as canonical records: a registry of adapters, each a DataFrame transformation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EDGE_CONFIDENCE
from ..functions import scalars as S

RELATIONS = "array<struct<target_type:string,target:string,relation:string,confidence:double>>"
RECORD = ("source_type", "record_id", "kind", "name", "aliases", "phones", "attributes", "text", "observed_at", "location", "relations")
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(source_type: str):
    def keep(f):
        ADAPTERS[source_type] = f
        return f

    return keep


def get_adapter(source_type: str) -> Callable[[DataFrame], DataFrame]:
    return ADAPTERS[source_type]


def source_types() -> list[str]:
    return sorted(ADAPTERS)


def parse_rows(texts: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """JSON texts, each one object or an array of objects, as rows; anything else is dropped."""
    body = F.trim(col)
    many = F.when(body.startswith("["), F.from_json(body, "array<string>")).when(body.startswith("{"), F.array(body))
    each = texts.select(F.explode(many).alias("one")).where(F.trim("one").startswith("{"))
    return each.select(F.from_json("one", f"struct<{schema}>").alias("r")).where("r is not null").select("r.*")


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _records(df: DataFrame, source_type: str, **given: Column) -> DataFrame:
    empty = {"name": F.lit(""), "aliases": F.array().cast("array<string>"), "phones": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>"), "text": F.lit(""), "observed_at": F.lit(""), "location": F.lit(""), "relations": F.array().cast(RELATIONS)}
    cols = empty | given | {"source_type": F.lit(source_type)}
    return df.select(*[cols[c].alias(c) for c in RECORD])


def _numbered(df: DataFrame, prefix: str, *ids: Column) -> tuple[DataFrame, Column]:
    """The first id that is there, else the prefix and a hash of the row, so that a row that
    comes again has the id that it had."""
    df = df.withColumn("_n", F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256), 1, 12))
    return df, F.coalesce(*[_blank(i) for i in ids], F.concat(F.lit(prefix), F.col("_n")))


@register("criminal_history")
def criminal_history(rows: DataFrame) -> DataFrame:
    rows, rid = _numbered(rows, "CH-", _col(rows, "record_id"))
    cases = F.transform(S.split_multi(_col(rows, "prior_case_ids")), lambda c: F.struct(F.lit("case").alias("target_type"), c.alias("target"), F.lit("ASSOCIATED_WITH").alias("relation"), F.lit(EDGE_CONFIDENCE["case"]).alias("confidence")))
    return _records(rows, "criminal_history", record_id=rid, kind=F.lit("person"), name=F.coalesce(F.trim(_col(rows, "name")), F.lit("")), aliases=S.split_multi(_col(rows, "aliases")), phones=S.split_multi(_col(rows, "phone")), attributes=F.create_map(F.lit("address"), F.coalesce(_col(rows, "address"), F.lit(""))), relations=cases)


@register("surveillance_report")
def surveillance_report(rows: DataFrame) -> DataFrame:
    rows, rid = _numbered(rows, "SR-", _col(rows, "record_id"), _col(rows, "report_id"))
    text = F.coalesce(_blank(_col(rows, "text")), _blank(_col(rows, "summary")), F.lit(""))
    head = lambda name: F.trim(F.regexp_extract(text, rf"(?i){name}\s*[:=]\s*(.+)", 1))
    return _records(rows, "surveillance_report", record_id=rid, kind=F.lit("text"), text=text, observed_at=F.coalesce(_blank(_col(rows, "observed_at")), head("observed_at")), location=F.coalesce(_blank(_col(rows, "location")), head("location")))


@register("social_media")
def social_media(rows: DataFrame) -> DataFrame:
    """Mentions are texts, or JSON objects with a name or a handle."""
    handle = _col(rows, "account_handle")
    rows, rid = _numbered(rows, "SM-", _col(rows, "record_id"), handle)
    mention = lambda m: F.trim(F.when(F.trim(m).startswith("{"), F.coalesce(_blank(F.get_json_object(m, "$.name")), F.get_json_object(m, "$.handle"))).otherwise(m))
    named = F.filter(F.transform(_col(rows, "mentions", "array<string>"), mention), lambda m: F.coalesce(m != "", F.lit(False)))
    rel = F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda m: F.struct(F.lit("person").alias("target_type"), m.alias("target"), F.lit("COMMUNICATES_WITH").alias("relation"), F.lit(EDGE_CONFIDENCE["communicates"]).alias("confidence")))
    return _records(rows, "social_media", record_id=rid, kind=F.lit("person"), name=F.coalesce(_blank(_col(rows, "author_name")), _blank(handle), F.concat(F.lit("SM-"), F.col("_n").cast("string"))), attributes=F.create_map(F.lit("account_handle"), F.coalesce(handle, F.lit("")), F.lit("platform"), F.coalesce(_col(rows, "platform"), F.lit(""))), relations=rel)


@register("agency_report")
def agency_report(rows: DataFrame) -> DataFrame:
    rows, rid = _numbered(rows, "AGY-", _col(rows, "record_id"))
    return _records(rows, "agency_report", record_id=rid, kind=F.lit("text"), text=F.coalesce(_col(rows, "text"), F.lit("")))


def person_nodes(records: DataFrame, case_id: str) -> DataFrame:
    """Entities of person records, and of the people and cases that they relate to."""
    own = records.where("kind = 'person'").select(F.lit(case_id).alias("case_id"), S.node_id(F.lit(case_id), F.lit("person"), "name").alias("id"), "name", "aliases", F.transform("phones", S.canonical_phone).alias("phone_numbers"), F.lit("PERSON").alias("entity_type"))
    rel = records.select(F.explode("relations").alias("r")).select("r.*")
    case = F.col("target_type") == "case"
    far = rel.select(F.lit(case_id).alias("case_id"), F.when(case, F.concat(F.lit("CASE-"), "target")).otherwise(S.node_id(F.lit(case_id), F.lit("person"), "target")).alias("id"), F.col("target").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("phone_numbers"), F.when(case, "CASE").otherwise("PERSON").alias("entity_type"))
    every = own.unionByName(far)
    return every.groupBy("case_id", "id").agg(F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phone_numbers")))).alias("phone_numbers"), F.first("entity_type").alias("entity_type"))


def relation_edges(records: DataFrame, case_id: str) -> DataFrame:
    r = records.where("kind = 'person'").select("source_type", "record_id", "name", F.explode("relations").alias("r")).select("*", "r.*")
    target = F.when(F.col("target_type") == "case", F.concat(F.lit("CASE-"), "target")).otherwise(S.node_id(F.lit(case_id), F.lit("person"), "target"))
    e = r.select(F.lit(case_id).alias("case_id"), S.node_id(F.lit(case_id), F.lit("person"), "name").alias("source_id"), target.alias("target_id"), F.col("relation").alias("relation_type"), F.col("confidence").alias("confidence_score"), F.concat_ws(":", "source_type", "record_id").alias("evidence_source"), F.lit("PENDING").alias("status"))
    return e.dropDuplicates(["source_id", "target_id", "relation_type"]).select(F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "relation_type").alias("id"), "*")


def observed_at(records: DataFrame, case_id: str) -> tuple[DataFrame, DataFrame]:
    """(edges, properties): the first person of a surveillance report was at its location."""
    from ..operators.extract import extract

    rows = extract(records.where("source_type = 'surveillance_report' and location <> ''").select("record_id", "text", "observed_at", "location"))
    first = F.get(F.filter("found", lambda e: e["entity_type"] == "person"), F.lit(0))
    rows = rows.withColumn("who", first["text"]).where("who is not null")
    e = rows.select(S.node_id(F.lit(case_id), F.lit("person"), "who").alias("source_id"), S.node_id(F.lit(case_id), F.lit("location"), "location").alias("target_id"), "record_id", S.normalize_ts("observed_at").alias("at"))
    e = e.withColumn("id", F.concat("source_id", F.lit("->"), "target_id", F.lit(":OBSERVED_AT")))
    edges = e.select("id", F.lit(case_id).alias("case_id"), "source_id", "target_id", F.lit("OBSERVED_AT").alias("relation_type"), F.lit(EDGE_CONFIDENCE["observed"]).alias("confidence_score"), F.concat(F.lit("surveillance_report:"), "record_id").alias("evidence_source"), F.lit("PENDING").alias("status")).dropDuplicates(["id"])
    return edges, e.where("at <> ''").select(F.col("id").alias("edge_id"), F.lit("observed_at").alias("key"), F.col("at").alias("value"))


def dispatch(source_type: str, rows: DataFrame, case_id: str, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """A feed's rows to records, nodes, edges and edge properties. Texts are extracted and
    ingested, those in ``runs`` (run_key) not again; surveillance also yields its
    observations."""
    from ..operators.extract import ingest_text

    records = get_adapter(source_type)(rows)
    out = {"records": records, "nodes": person_nodes(records, case_id), "edges": relation_edges(records, case_id)}
    texts = records.where("kind = 'text' and text <> ''").select("record_id", "text")
    none = records.sparkSession.createDataFrame([], "run_key string") if runs is None else runs
    out["text"] = ingest_text(texts, none, case_id, source_type)
    if source_type == "surveillance_report":
        out["observed"], out["properties"] = observed_at(records, case_id)
    return out
