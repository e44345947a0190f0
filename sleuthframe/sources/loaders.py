"""Readers of case files, the loaders of reports, calls and transfers, and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EDGE_CONFIDENCE
from ..functions import scalars as S
from .adapters import parse_rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def read_csv_text(spark: SparkSession, text: str) -> DataFrame:
    """A CSV text with a header as rows of texts; quoted values may hold line breaks."""
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text, newline="")))
    names = [n.strip() for n in rows[0]] if rows else []
    width = len(names)
    cut = [tuple((*r, *[None] * width)[:width]) for r in rows[1:] if any(r)]
    return spark.createDataFrame(cut, ", ".join(f"`{n}` string" for n in names))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An array or object over many lines, or an object a line: the first line tells which."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    lines = bool(first) and first[0][0].strip().startswith("{") and first[0][0].strip().endswith("}")
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: (record_id, text)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1).alias("record_id"), F.col("value").alias("text"))


def read_json_text(spark: SparkSession, text: str, schema: str) -> DataFrame:
    return parse_rows(spark.createDataFrame([(text,)], "value string"), schema)


def read_either(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """JSON if the folder has it, else CSV."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
    return read_json(spark, f"{folder}/{name}.json", schema) if path.getFileSystem(conf).exists(path) else read_csv(spark, f"{folder}/{name}.csv")


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.text(path) if kind == "text" else w.json(path)


def fir_edges(firs: DataFrame, case_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): people named in one paragraph are mentioned together."""
    para = firs.select("fir_no", F.posexplode(S.paragraphs("text")).alias("n", "p"))
    people = para.select("fir_no", "n", F.array_distinct(F.transform(F.concat(S.find_all("p", S.NAME), S.find_all("p", S.DEVANAGARI_NAME)), lambda v: F.trim(v))).alias("who"), F.substring("p", 1, 220).alias("evidence"))
    named = people.select("fir_no", "n", F.posexplode("who").alias("i", "name"), "evidence")
    nodes = named.select(F.lit(case_id).alias("case_id"), S.node_id(F.lit(case_id), F.lit("person"), "name").alias("id"), "name").dropDuplicates(["id"]).withColumn("entity_type", F.lit("PERSON"))
    pair = F.flatten(F.transform("who", lambda a, i: F.transform(F.filter("who", lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    e = people.select("fir_no", "evidence", F.explode(pair).alias("x")).select("fir_no", "evidence", S.node_id(F.lit(case_id), F.lit("person"), "x.a").alias("source_id"), S.node_id(F.lit(case_id), F.lit("person"), "x.b").alias("target_id"))
    return nodes, _edges(e, case_id, "CO_MENTIONED", EDGE_CONFIDENCE["fir"], F.concat(F.lit("FIR "), "fir_no", F.lit(": "), "evidence"))


def _edges(e: DataFrame, case_id: str, relation: str, confidence: float, evidence) -> DataFrame:
    e = e.where("source_id <> target_id").select(F.lit(case_id).alias("case_id"), "source_id", "target_id", F.lit(relation).alias("relation_type"), F.lit(confidence).alias("confidence_score"), evidence.alias("evidence_source"), F.lit("PENDING").alias("status"))
    return e.withColumn("id", F.concat_ws("", "source_id", F.lit("->"), "target_id", F.lit(f":{relation}:"), S.content_hash("evidence_source")))


def phone_owner(calls: DataFrame, people: DataFrame, col: str) -> DataFrame:
    """The person (least id) who has the phone, else a node of the phone itself."""
    owner = people.select(F.explode(F.transform("phone_numbers", S.normalize_phone)).alias("_p"), F.col("id").alias("_o")).where("_p <> ''").groupBy("_p").agg(F.min("_o").alias("_o"))
    return calls.withColumn("_p", S.normalize_phone(col)).join(owner, "_p", "left").withColumn(f"{col}_id", F.coalesce("_o", F.concat(F.lit("PHONE-"), "_p"))).drop("_p", "_o")


def cdr_edges(calls: DataFrame, people: DataFrame, case_id: str) -> DataFrame:
    c = calls.where("coalesce(trim(caller), '') <> '' and coalesce(trim(callee), '') <> ''")
    c = phone_owner(phone_owner(c, people, "caller"), people, "callee")
    e = c.select(F.col("caller_id").alias("source_id"), F.col("callee_id").alias("target_id"), "timestamp", "duration_sec")
    return _edges(e, case_id, "CALLED", EDGE_CONFIDENCE["cdr"], F.concat_ws(" ", F.lit("CDR"), F.col("timestamp").cast("string"), F.concat(F.col("duration_sec").cast("string"), F.lit("s"))))


def txn_edges(txns: DataFrame, case_id: str) -> DataFrame:
    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in txns.columns], F.lit(None).cast("string"))
    e = txns.select(F.concat(F.lit("ACCT-"), get("from_acct", "from")).alias("source_id"), F.concat(F.lit("ACCT-"), get("to_acct", "to")).alias("target_id"), get("amount", "amount_inr").alias("amount"), get("timestamp", "date").alias("at")).where("source_id is not null and target_id is not null")
    return _edges(e, case_id, "SUSPICIOUS_TRANSFER", EDGE_CONFIDENCE["txn"], F.concat_ws(" ", F.lit("TXN"), "at", F.concat(F.lit("INR "), "amount")))


def fir_people(firs: DataFrame, case_id: str) -> DataFrame:
    """People named in reports (case_id, id, name, phone_numbers): the phones of a paragraph
    go with every person in it."""
    para = firs.select("fir_no", F.posexplode(S.paragraphs("text")).alias("n", "p"))
    who = F.array_distinct(F.transform(F.concat(S.find_all("p", S.NAME), S.find_all("p", S.DEVANAGARI_NAME)), lambda v: F.trim(v)))
    phones = F.filter(F.transform(S.find_all("p", S.PHONE), S.canonical_phone), lambda v: v != "")
    rows = para.select(F.explode(who).alias("name"), phones.alias("phones")).select(S.node_id(F.lit(case_id), F.lit("person"), "name").alias("id"), "name", "phones")
    return rows.groupBy("id").agg(F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phones")))).alias("phone_numbers")).select(F.lit(case_id).alias("case_id"), "id", "name", "phone_numbers", F.lit("PERSON").alias("entity_type"))


def end_nodes(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes of phones and accounts at the ends of edges that no known entity stands for."""
    ends = edges.select("case_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(known.select("id"), "id", "left_anti")
    kind = F.when(F.col("id").startswith("PHONE-"), "PHONE").when(F.col("id").startswith("ACCT-"), "BANK_ACCOUNT").otherwise("PERSON")
    phones = F.when(F.col("id").startswith("PHONE-"), F.array(S.canonical_phone(F.substring("id", 7, 20)))).otherwise(F.array().cast("array<string>"))
    return ends.select("case_id", "id", F.regexp_replace("id", "^(PHONE|ACCT)-", "").alias("name"), phones.alias("phone_numbers"), kind.alias("entity_type"))


def account_owner(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of transfers that bear an entity's name (any type; least id) become that entity."""
    owner = entities.groupBy("case_id", F.lower(F.trim("name")).alias("_k")).agg(F.min("id").alias("_o"))
    for end in ("source_id", "target_id"):
        key = F.lower(F.regexp_replace(end, "^ACCT-", ""))
        edges = edges.withColumn("_k", key).join(owner, ["case_id", "_k"], "left").withColumn(end, F.coalesce("_o", end)).drop("_k", "_o")
    return edges.where("source_id <> target_id")


def load_folder(spark: SparkSession, folder: str, case_id: str) -> dict[str, DataFrame]:
    """Reports, calls and transfers of a folder as nodes and edges."""
    firs = read_either(spark, folder, "firs")
    _, mentioned = fir_edges(firs, case_id)
    people = fir_people(firs, case_id)
    calls = cdr_edges(read_either(spark, folder, "cdrs"), people, case_id)
    transfers = account_owner(txn_edges(read_either(spark, folder, "transactions"), case_id), people)
    edges = mentioned.unionByName(calls).unionByName(transfers.select(*mentioned.columns))
    return {"nodes": people.unionByName(end_nodes(edges, people)), "edges": edges}


def load_sources(spark: SparkSession, folder: str, case_id: str, feeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The run over all seven sources: a folder's reports, calls and transfers, and the four
    feeds by their types; then the case is resolved once. Entities, edges, edge properties,
    spans, merge log, reviews and counts."""
    from ..operators import resolve, state
    from .adapters import dispatch

    base = load_folder(spark, folder, case_id)
    nodes, edges, spans, props = [base["nodes"]], [base["edges"]], [], []
    for kind, rows in feeds.items():
        out = dispatch(kind, rows, case_id)
        nodes += [out["nodes"], out["text"]["nodes"]]
        edges += [out["edges"], out["text"]["edges"], *([out["observed"]] if "observed" in out else [])]
        spans.append(out["text"]["spans"])
        props += [out["properties"]] if "properties" in out else []
    every = lambda parts: functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    none = F.array().cast("array<string>")
    people = every(nodes)
    for c in ("aliases", "phone_numbers"):
        people = people.withColumn(c, F.coalesce(F.col(c), none) if c in people.columns else none)
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("aliases", "phone_numbers")]
    people = people.groupBy("case_id", "id").agg(F.min("name").alias("name"), *sets, F.min("entity_type").alias("entity_type")).withColumn("base_risk_score", F.lit(50.0))
    links = every(edges).dropDuplicates(["case_id", "id"])
    done = resolve.resolve_case(people, links)
    stats = state.ingest_stats(done["entities"], done["edges"])
    return done | {"stats": stats} | ({"spans": every(spans)} if spans else {}) | ({"properties": every(props)} if props else {})


def synthetic_case(spark: SparkSession, calls: int = 500, transfers: int = 100) -> dict[str, DataFrame]:
    """A made-up case of the usual shape: two core phones that call much and at night, fan-out
    to a burner phone, and a circle of three accounts run through twice."""
    n = F.col("id")
    core, burner = F.array(F.lit("9000000001"), F.lit("9000000002")), "9000000099"
    caller = F.when(n < 43, F.get(core, (n % 2).cast("int"))).otherwise(F.concat(F.lit("91000000"), F.lpad((n * 7 % 40).cast("string"), 2, "0")))
    callee = F.when(n < 40, F.get(core, ((n + 1) % 2).cast("int"))).when(n < 43, F.lit(burner)).otherwise(F.concat(F.lit("91000000"), F.lpad(((n * 11 + 3) % 40).cast("string"), 2, "0")))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = start + F.make_dt_interval(hours=F.when(n < 43, n % 30 * 24 + 2).otherwise(n * 5 % 720), mins=n * 13 % 60)
    cdr = spark.range(calls).select(F.concat(F.lit("CDR-"), n.cast("string")).alias("id"), caller.alias("caller"), callee.alias("callee"), at.alias("timestamp"), (30 + n * 17 % 600).cast("int").alias("duration_sec"))
    ring = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    frm = F.when(n < 6, F.get(ring, (n % 3).cast("int"))).otherwise(F.concat(F.lit("X"), (n * 7 % 30).cast("string")))
    to = F.when(n < 6, F.get(ring, ((n + 1) % 3).cast("int"))).otherwise(F.concat(F.lit("X"), ((n * 11 + 5) % 30).cast("string")))
    txn = spark.range(transfers).select(F.concat(F.lit("TXN-"), n.cast("string")).alias("id"), frm.alias("from_acct"), to.alias("to_acct"), (10000.0 + n * 997 % 50000).alias("amount"), F.date_add(F.lit("2024-01-01").cast("date"), (n * 3 % 60).cast("int")).alias("timestamp"))
    return {"cdrs": cdr, "transactions": txn}
