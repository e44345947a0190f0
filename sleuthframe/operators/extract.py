"""Entities and relations from text, with spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXTRACTION_CONFIDENCE
from ..functions import scalars as S

FOUND = "array<struct<entity_type:string,text:string,span_start:int,span_end:int,confidence:double>>"
SENTENCES = "array<struct<n:int,text:string,start:int,end:int>>"
_PHONE, _VEHICLE, _NAME = re.compile(S.PHONE), re.compile(S.VEHICLE), re.compile(S.NAME)
_BREAK = re.compile(r"(?<=[.!?\n])\s+")


def anchors(text: str) -> list[tuple]:
    out = []
    for m in _PHONE.finditer(text):
        d = re.sub(r"\D", "", m[0])
        d = d[2:] if len(d) == 12 and d[:2] == "91" else d[1:] if len(d) == 11 and d[0] == "0" else d
        if len(d) == 10 and d[0] in "6789":
            out.append(("phone", m[0], m.start(), m.end(), EXTRACTION_CONFIDENCE["phone"]))
    return out + [("vehicle", m[0], m.start(), m.end(), EXTRACTION_CONFIDENCE["vehicle"]) for m in _VEHICLE.finditer(text)]


def capitalised(text: str) -> list[tuple]:
    """Pairs of capitalised words as people: the backend without a model."""
    return [("person", m[0].strip(), m.start(), m.end(), EXTRACTION_CONFIDENCE["person"]) for m in _NAME.finditer(text)]


def entities_in(text: str, backend: Callable[[str], list[tuple]] | None = None) -> list[tuple]:
    """Anchors and names, once per type and span, in order of place. Where the backend finds
    no person, capitalised pairs stand in."""
    named = backend(text) if backend else []
    if not any(e[0] == "person" for e in named):
        named = named + capitalised(text)
    first = {(e[0], e[2], e[3]): e for e in reversed(anchors(text) + named)}
    return sorted(first.values(), key=lambda e: e[2])


def sentence_spans(text: str) -> list[tuple[int, str, int, int]]:
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((len(out), text[at:end], at, end))
        at = m.end() if m else end
    return out or [(0, text, 0, len(text))]


def extract(docs: DataFrame, text_col: str = "text", backend: Callable[[str], list[tuple]] | None = None) -> DataFrame:
    """The input with ``found`` and ``sentences``, in Arrow batches. A backend is any function
    from a text to (type, text, start, end, confidence)."""
    schema = docs.schema.simpleString()[7:-1] + f",found:{FOUND},sentences:{SENTENCES}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, spans = ("entity_type", "text", "span_start", "span_end", "confidence"), ("n", "text", "start", "end")
        for part in parts:
            texts = [t if isinstance(t, str) else "" for t in part[text_col]]
            yield part.assign(found=[[dict(zip(kinds, e, strict=True)) for e in entities_in(t, backend)] for t in texts], sentences=[[dict(zip(spans, s, strict=True)) for s in sentence_spans(t)] for t in texts])

    return docs.mapInPandas(run, schema)


def relations(extracted: DataFrame, id_col: str) -> DataFrame:
    """Relations of entities that share a sentence, once per pair and kind of a document: all
    pairs are associated; persons (or, by a trigger word, anything) use its phones and vehicles."""
    s = extracted.select(id_col, "found", F.explode("sentences").alias("s"))
    inside = F.filter("found", lambda e: (e["span_start"] >= F.col("s.start")) & (e["span_end"] <= F.col("s.end")))
    s = s.withColumn("inside", inside).where(F.size("inside") > 1).withColumn("people", F.filter("inside", lambda e: e["entity_type"] == "person"))
    one = lambda a, b, rel, conf: F.struct(a["text"].alias("a_text"), a["entity_type"].alias("a_type"), b["text"].alias("b_text"), b["entity_type"].alias("b_type"), F.lit(rel).alias("relation"), F.lit(conf).alias("confidence"))
    pairs = F.flatten(F.transform("inside", lambda a, i: F.transform(F.filter("inside", lambda b, j: j > i), lambda b: one(a, b, "ASSOCIATED_WITH", 0.6))))
    users = F.when(F.size("people") > 0, F.col("people")).when(F.col("s.text").rlike(S.TRIGGER), F.col("inside")).otherwise(F.slice("inside", 1, 0))
    things = F.filter("inside", lambda e: e["entity_type"].isin("phone", "vehicle"))
    uses = F.flatten(F.transform(users, lambda a: F.transform(F.filter(things, lambda b: ~((a["span_start"] == b["span_start"]) & (a["entity_type"] == b["entity_type"]))), lambda b: one(a, b, "USES", 0.75))))
    rows = s.select(id_col, F.col("s.n").alias("n"), F.substring(F.trim("s.text"), 1, 280).alias("evidence"), F.explode(F.concat(pairs, uses)).alias("r")).select(id_col, "n", "evidence", "r.*")
    return rows.groupBy(id_col, "a_text", "b_text", "relation").agg(F.min_by(F.struct("a_type", "b_type", "confidence", "evidence"), "n").alias("x")).select(id_col, "a_text", "b_text", "relation", "x.*")


def ingest_text(docs: DataFrame, runs: DataFrame, case_id: str, source_type: str, id_col: str = "record_id", backend=None) -> dict[str, DataFrame]:
    """Texts whose content is new, to nodes, spans, edges and run rows."""
    keyed = docs.withColumns({"content_hash": S.content_hash("text"), "run_key": S.run_key(F.lit(source_type), F.col(id_col).cast("string"), "text")})
    fresh = extract(keyed.join(runs.select("run_key"), "run_key", "left_anti"), backend=backend)
    found = fresh.select(id_col, F.explode("found").alias("e")).select(id_col, "e.*").withColumn("node", S.node_id(F.lit(case_id), "entity_type", "text"))
    nodes = found.groupBy("node").agg(F.min_by("text", F.struct(id_col, "span_start")).alias("name"), F.first("entity_type").alias("entity_type")).select(F.lit(case_id).alias("case_id"), F.col("node").alias("id"), "name", F.upper("entity_type").alias("entity_type"))
    spans = found.select(F.col("node").alias("entity_id"), F.lit(case_id).alias("case_id"), F.lit(source_type).alias("source_type"), F.col(id_col).alias("record_id"), "span_start", "span_end", "confidence").distinct()
    rel = relations(fresh, id_col)
    edges = rel.select(S.node_id(F.lit(case_id), "a_type", "a_text").alias("source_id"), S.node_id(F.lit(case_id), "b_type", "b_text").alias("target_id"), F.col("relation").alias("relation_type"), F.col("confidence").alias("confidence_score"), F.col("evidence").alias("evidence_source"), F.when(F.col("relation") == "USES", "CONFIRMED").otherwise("PENDING").alias("status")).where("source_id <> target_id")
    edges = edges.dropDuplicates(["source_id", "target_id", "relation_type"]).select(F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "relation_type").alias("id"), F.lit(case_id).alias("case_id"), "*")
    return {"nodes": nodes, "spans": spans, "edges": edges, "runs": fresh.select("run_key", F.lit(source_type).alias("source_type"), id_col, "content_hash")}


def extract_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The model-free extraction as native columns: phones, vehicles, persons, locations."""
    people = F.concat(S.find_all(text_col, S.NAME), S.find_all(text_col, S.DEVANAGARI_NAME))
    return docs.withColumns({"phones": F.array_distinct(F.transform(S.find_all(text_col, S.PHONE), S.loose_phone)), "vehicles": F.array_distinct(S.find_all(text_col, S.VEHICLE_STRICT)), "persons": F.array_distinct(F.transform(people, lambda v: F.trim(v))), "locations": F.array_distinct(F.transform(S.find_all(text_col, S.DEVANAGARI_PLACE, 1), lambda v: F.trim(v)))})
