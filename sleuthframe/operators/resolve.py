"""Entity resolution: blocking, the five rules, merging as connected components, review,
undoing. Name similarity alone never merges; it asks for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Resolution
from ..functions import scalars as S
from ..functions.similarity import signs, similarity
from ..scratch import Scratch, components
from . import state


def classify(shares_phone: Column, shares_vehicle: Column, sim: Column, words_a: Column, words_b: Column, cfg: Resolution = Resolution()) -> Column:
    """The rule that a pair falls under: auto_r1, auto_r2, review_r3, separate_r4, review_r5 or null."""
    return (
        F.when(shares_phone & (sim >= cfg.merge), "auto_r1").when(shares_vehicle & (sim >= cfg.merge), "auto_r2").when(shares_phone & (sim >= cfg.review), "review_r3")
        .when(shares_phone, "separate_r4").when((words_a >= 2) & (words_b >= 2) & (sim >= cfg.name_only), "review_r5")
    )


def block_keys(people: DataFrame, aliases: bool = False) -> DataFrame:
    """(case_id, key, id): a person's phones, vehicles and name words."""
    phones = F.transform("phone_numbers", lambda p: F.when(S.normalize_phone(p) != "", F.concat(F.lit("ph:"), S.normalize_phone(p))))
    cars = F.transform(F.coalesce("vehicles", F.array().cast("array<string>")), lambda v: F.concat(F.lit("ve:"), S.normalize_vehicle(v)))
    words = S.name_tokens("name")
    if aliases:
        words = F.concat(words, F.flatten(F.transform("aliases", S.name_tokens)))
    names = F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.concat(F.lit("nm:"), w))
    return people.select("case_id", "id", F.explode(F.array_distinct(F.array_compact(F.concat(phones, cars, names)))).alias("key"))


def _met(left: DataFrame, keys: DataFrame, chunk: int, where: str) -> DataFrame:
    """Pairs of members of the same block, each once. A block of more than ``chunk`` members is dealt
    into chunks and met chunk by chunk, so no task holds a common name's whole block."""
    size = keys.groupBy("case_id", "key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("c")).where(F.col("c") >= 1)
    one = left.join(size.hint("merge"), ["case_id", "key"]).select("case_id", "key", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    two = keys.join(size.hint("merge"), ["case_id", "key"]).select("case_id", "key", F.col("id").alias("b"), F.pmod(F.xxhash64("id"), F.col("c")).cast("int").alias("other"))
    return one.join(two.hint("merge"), ["case_id", "key", "other"]).where(where).select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_pairs(people: DataFrame, aliases: bool = False, chunk: int = 500) -> DataFrame:
    """Pairs that share a block, each once."""
    keys = block_keys(people, aliases)
    return _met(keys, keys, chunk, "a < b")


def likely_pairs(people: DataFrame, cfg: Resolution = Resolution(), chunk: int = 500, common: int = 50) -> DataFrame:
    """The candidate pairs without those that fall under no rule because they share nothing but
    words of more than ``common`` people each: of these only pairs whose names can be alike by
    ``cfg.name_only`` are met (``similarity.signs``). No pair with a rule is lost."""
    if cfg.name_only <= 90:  # An initial may then be enough.
        return candidate_pairs(people, chunk=chunk)
    scratch = Scratch(people.sparkSession, "blocks")
    keys = scratch.save(block_keys(people), "keys")
    hot = scratch.save(keys.where("key like 'nm:%'").groupBy("case_id", "key").agg(F.count("*").alias("n")).where(F.col("n") > common).select("case_id", "key"), "hot")
    rare, often = keys.join(hot, ["case_id", "key"], "left_anti"), keys.join(hot, ["case_id", "key"])
    own = often.groupBy("case_id", "id").agg(F.collect_set(F.substr("key", F.lit(4))).alias("hot"))
    named = people.select("case_id", "id", "name", S.name_tokens("name").alias("words")).where(F.size("words") >= 2).join(own.hint("merge"), ["case_id", "id"])
    marks = scratch.save(named.mapInArrow(signs(cfg.name_only / 100), "case_id string, id string, kind string, key string, cut int, most int, size int"), "signs")
    ordered = lambda df: df.where("a <> b").select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    side = lambda kind, s: marks.where(F.col("kind") == kind).select("case_id", "key", F.col("id").alias(s), F.col("cut").alias(f"cut_{s}"), F.col("size").alias(f"size_{s}"), "most")
    within = ordered(side("core", "a").drop("most").join(side("part", "b").drop("most").hint("merge"), ["case_id", "key"]))
    # A form cut so often meets those forms only that were cut no more often than is left.
    one = side("rest", "a").withColumn("cut_b", F.explode(F.sequence(F.lit(0), F.col("most") - F.col("cut_a")))).drop("most")
    near = ordered(one.join(side("rest", "b").drop("most").hint("merge"), ["case_id", "key", "cut_b"]).where(F.col("cut_a") + F.col("cut_b") <= (F.col("size_a") + F.col("size_b")) * (1 - cfg.name_only / 100) + 1e-6))
    wide = often.join(marks.where("kind = 'wide'").select("case_id", "id").distinct(), ["case_id", "id"], "left_semi")
    return _met(rare, rare, chunk, "a < b").unionByName(within).unionByName(near).unionByName(_met(wide, often, chunk, "a <> b")).distinct()


def with_vehicles(people: DataFrame) -> DataFrame:
    return people if "vehicles" in people.columns else people.withColumn("vehicles", F.array().cast("array<string>"))


def classify_pairs(people: DataFrame, cfg: Resolution = Resolution()) -> DataFrame:
    """Every likely pair of a case with its similarity and rule: all that have a rule are among them."""
    people = with_vehicles(people.where(F.upper("entity_type") == "PERSON"))
    side = lambda s: people.select("case_id", F.col("id").alias(s), F.col("name").alias(f"name_{s}"), F.array_remove(F.transform("phone_numbers", S.normalize_phone), "").alias(f"ph_{s}"), F.transform("vehicles", S.normalize_vehicle).alias(f"ve_{s}"))
    # The planner takes people and marks for as small as their compressed files: merged, not broadcast.
    pairs = likely_pairs(people, cfg).join(side("a").hint("merge"), ["case_id", "a"]).join(side("b").hint("merge"), ["case_id", "b"])
    pairs = pairs.withColumn("sim", similarity("name_a", "name_b"))
    rule = classify(F.arrays_overlap("ph_a", "ph_b"), F.arrays_overlap("ve_a", "ve_b"), F.col("sim"), F.size(S.name_tokens("name_a")), F.size(S.name_tokens("name_b")), cfg)
    return pairs.select("case_id", "a", "b", "sim", rule.alias("rule"), F.array_intersect("ph_a", "ph_b").alias("phones"))


def alias_pairs(people: DataFrame, cfg: Resolution = Resolution()) -> DataFrame:
    """As classify_pairs over names and aliases: a shared phone merges, else very like names
    ask for review."""
    people = people.where(F.upper("entity_type") == "PERSON")
    forms = people.select("case_id", "id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form"))
    phones = people.select("case_id", "id", F.array_remove(F.transform("phone_numbers", S.normalize_phone), "").alias("ph"))
    pairs = candidate_pairs(with_vehicles(people), aliases=True)
    pairs = pairs.join(forms.withColumnsRenamed({"id": "a", "form": "fa"}), ["case_id", "a"]).join(forms.withColumnsRenamed({"id": "b", "form": "fb"}), ["case_id", "b"])
    best = pairs.withColumn("sim", similarity("fa", "fb")).groupBy("case_id", "a", "b").agg(F.max("sim").alias("sim"))
    best = best.join(phones.withColumnsRenamed({"id": "a", "ph": "pa"}), ["case_id", "a"]).join(phones.withColumnsRenamed({"id": "b", "ph": "pb"}), ["case_id", "b"])
    rule = F.when(F.arrays_overlap("pa", "pb") & (F.col("sim") >= cfg.merge), "auto_alias").when(F.col("sim") >= cfg.name_only, "review_alias")
    return best.select("case_id", "a", "b", "sim", rule.alias("rule"))


def merge_map(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(case_id, id, survivor): components of the automatic pairs and of the pairs that a
    review accepted, the least id survives. Raises if ``rounds`` do not settle them."""
    taken = F.col("rule").startswith("auto")
    if "decision" in pairs.columns:
        taken = taken | (F.col("decision") == "accepted")
    edges = pairs.where(taken).select(F.struct("case_id", F.col("a").alias("id")).alias("a"), F.struct("case_id", F.col("b").alias("id")).alias("b"))
    found = components(edges, Scratch(pairs.sparkSession, "merge"), "merge", rounds)
    every = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    return every.select("node.case_id", "node.id", F.col("root.id").alias("survivor"))


def merge_entities(entities: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, log) after merging. Edge ids become old::merged->survivor, self-loops
    go, and the log keeps what is needed to undo the merge."""
    losers = mapping.where("id <> survivor")
    e = entities.join(mapping, ["case_id", "id"], "left").withColumn("survivor", F.coalesce("survivor", "id"))
    names = e.groupBy("case_id", "survivor", "name").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    name = names.groupBy("case_id", "survivor").agg(F.max_by("name", F.struct("n", F.length("name"), "name")).alias("name"))
    sets = e.groupBy("case_id", "survivor").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phone_numbers")))).alias("phone_numbers"), F.max("base_risk_score").alias("base_risk_score"), F.min_by("entity_type", "id").alias("entity_type"))
    merged = sets.join(name, ["case_id", "survivor"]).select("case_id", F.col("survivor").alias("id"), "name", F.array_remove(F.col("forms"), F.col("name")).alias("aliases"), "phone_numbers", "entity_type", "base_risk_score")
    to = lambda c: losers.select("case_id", F.col("id").alias(c), F.col("survivor").alias(f"{c}_to"))
    moved = edges.join(to("source_id"), ["case_id", "source_id"], "left").join(to("target_id"), ["case_id", "target_id"], "left")
    hit = F.coalesce("source_id_to", "target_id_to")
    old = F.when(F.col("source_id_to").isNotNull(), F.col("source_id")).otherwise(F.col("target_id"))
    moved = moved.withColumns({"id": F.when(hit.isNotNull(), F.concat("id", F.lit("::"), old, F.lit("->"), hit)).otherwise(F.col("id")), "source_id": F.coalesce("source_id_to", "source_id"), "target_id": F.coalesce("target_id_to", "target_id")})
    moved = moved.where(hit.isNull() | (F.col("source_id") != F.col("target_id"))).select(*edges.columns)
    before = entities.join(mapping, ["case_id", "id"]).groupBy("case_id", "survivor").agg(F.array_sort(F.collect_list(F.struct(*[entities[c] for c in entities.columns]))).alias("entities"))
    log = before.select(S.merge_id("survivor", F.transform("entities", lambda x: x["id"]), F.lit("exact_anchor+name")).alias("id"), "case_id", F.col("survivor").alias("surviving_entity_id"), F.transform("entities", lambda x: x["id"]).alias("merged_entity_ids"), F.lit("auto").alias("decision"), "entities")
    return merged, moved, log


def unmerge(entities: DataFrame, edges: DataFrame, original_edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges before the logged merges; edges that other merges moved stay moved."""
    back = log.select(F.explode("entities").alias("e")).select("e.*")
    kept = entities.join(log.select("case_id", F.col("surviving_entity_id").alias("id")), ["case_id", "id"], "left_anti")
    undone = log.select(F.col("case_id").alias("_case"), F.col("surviving_entity_id").alias("_to"), F.explode("merged_entity_ids").alias("_node"))
    at = lambda df, c: df.join(undone.select(F.col("_case").alias("case_id"), F.col("_node").alias(c)).distinct(), ["case_id", c], "left_semi").select(*df.columns)
    restored = at(original_edges, "source_id").unionByName(at(original_edges, "target_id")).distinct()
    part = lambda k: F.regexp_extract("id", r"::([^:]*)->([^:]*)$", k)
    moved = edges.withColumns({"_from": part(1), "_onto": part(2)})
    mine = (F.col("_from") == F.col("_node")) & (F.col("_onto") == F.col("_to")) & (F.col("case_id") == F.col("_case"))
    rest = moved.join(undone, mine, "left_anti").select(*edges.columns)
    rest = rest.join(restored.select("case_id", "id"), ["case_id", "id"], "left_anti").select(*edges.columns)
    return kept.unionByName(back.select(*kept.columns)), rest.unionByName(restored)


def review_queue(pairs: DataFrame) -> DataFrame:
    """Pairs for a human, under an id of both, with their confidence."""
    q = pairs.where(F.col("rule").startswith("review"))
    return q.select(F.concat(F.lit("REVIEW-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "case_id", "a", "b"), 256), 1, 12))).alias("id"), "case_id", "a", "b", "rule", (F.col("sim") / 100).alias("confidence"), F.lit("pending").alias("decision"))


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after decisions (id, decision): accepted or rejected, once and for all. Its
    accepted pairs are merged by ``merge_map`` like automatic ones."""
    allowed = F.when(F.col("decision").isin("accepted", "rejected"), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("unknown decision "), "decision")))
    d = decisions.select("id", allowed.alias("_d"))
    return queue.join(d, "id", "left").withColumn("decision", F.when(F.col("decision") == "pending", F.coalesce("_d", "decision")).otherwise(F.col("decision"))).select(*queue.columns)


def pending_reviews(queue: DataFrame, case_id: str | None = None) -> DataFrame:
    """Open questions of all cases or of one, the surest first."""
    own = queue.where("decision = 'pending'")
    return (own if case_id is None else own.where(F.col("case_id") == case_id)).orderBy(F.desc("confidence"), "id")


def resolve_case(entities: DataFrame, edges: DataFrame, cfg: Resolution = Resolution(), aliases: bool = False, reviewed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole resolution of all cases at once: entities and edges after merging, the merge
    log, the review queue, and every pair with its rule. Phones that different people share
    become nodes that they use. ``reviewed`` is a queue with decisions: accepted pairs merge,
    rejected ones neither merge nor come up again."""
    scratch = Scratch(entities.sparkSession, "resolve")
    pairs = classify_pairs(entities, cfg)
    if aliases:
        more = alias_pairs(entities, cfg).withColumn("phones", F.array().cast("array<string>")).where("rule is not null")
        pairs = pairs.unionByName(more.select(*pairs.columns))
    pairs = pairs.withColumn("decision", F.lit(None).cast("string"))
    if reviewed is not None:
        known = reviewed.where("decision <> 'pending'").groupBy("case_id", "a", "b").agg(F.max("decision").alias("_d"))
        pairs = pairs.join(known, ["case_id", "a", "b"], "left").withColumn("decision", F.col("_d")).drop("_d").where("decision is null or decision <> 'rejected'")
    pairs = scratch.save(pairs, "pairs")
    mapping = scratch.save(merge_map(pairs), "map")
    merged, moved, log = merge_entities(entities, edges, mapping)
    nodes, uses = shared_phone_nodes(pairs)
    gone = mapping.where("id <> survivor").select("case_id", F.col("id").alias("source_id"), "survivor")
    uses = uses.join(gone, ["case_id", "source_id"], "left").withColumn("source_id", F.coalesce("survivor", "source_id")).withColumn("id", F.concat("source_id", F.lit("->"), "target_id", F.lit(":USES"))).drop("survivor").dropDuplicates(["case_id", "id"])
    new = nodes.join(merged.select("case_id", "id"), ["case_id", "id"], "left_anti")
    fresh = uses.join(moved.select("case_id", "id"), ["case_id", "id"], "left_anti")
    return {"entities": merged.unionByName(new, allowMissingColumns=True), "edges": moved.unionByName(fresh, allowMissingColumns=True), "log": log, "reviews": review_queue(pairs.where("decision is null")), "pairs": pairs}


def ingest_canonical(entities: DataFrame, edges: DataFrame, sources: DataFrame, new: DataFrame, refs: DataFrame, **options) -> dict[str, DataFrame]:
    """New canonical entities (case_id, name, aliases, phone_numbers, entity_type,
    base_risk_score) under their node ids, once per id, with what supports them
    (refs: the same keys and source_type, record_id, field, span_start, span_end, confidence);
    then the case is resolved once for the whole batch."""
    keyed = lambda df: df.withColumn("id", S.node_id("case_id", F.lower("entity_type"), "name", F.array_sort(F.transform("phone_numbers", S.normalize_phone))))
    every = state.upsert_entities(entities, keyed(new).select(*entities.columns))
    found = keyed(refs).withColumnRenamed("id", "entity_id").select(*sources.columns)
    return resolve_case(every, edges, **options) | {"sources": sources.unionByName(found).distinct()}


def entity_detail(entities: DataFrame, sources: DataFrame, log: DataFrame) -> DataFrame:
    """Each entity with its sources and the merges that it took part in, by whole ids."""
    own = sources.groupBy("case_id", F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_type", "record_id", "span_start", "span_end", "confidence"))).alias("sources"))
    part = log.select("case_id", F.explode(F.array_distinct(F.concat("merged_entity_ids", F.array("surviving_entity_id")))).alias("id"), F.col("id").alias("merge"))
    merges = part.groupBy("case_id", "id").agg(F.array_sort(F.collect_list("merge")).alias("merges"))
    return entities.join(own, ["case_id", "id"], "left").join(merges, ["case_id", "id"], "left")


def shared_phone_nodes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of phones that different people share: both USE a node of their own."""
    rows = pairs.where("rule = 'separate_r4'").select("case_id", "a", "b", F.explode("phones").alias("phone"))
    nodes = rows.select("case_id", F.concat(F.lit("PHONE-"), "phone").alias("id"), S.canonical_phone("phone").alias("name"), F.lit("PHONE").alias("entity_type")).distinct()
    ends = rows.select("case_id", F.explode(F.array("a", "b")).alias("source_id"), F.concat(F.lit("PHONE-"), "phone").alias("target_id")).distinct()
    return nodes, ends.select(F.concat("source_id", F.lit("->"), "target_id", F.lit(":USES")).alias("id"), "case_id", "source_id", "target_id", F.lit("USES").alias("relation_type"), F.lit(0.9).alias("confidence_score"), F.lit("CONFIRMED").alias("status"))


def greedy_resolver(mentions: DataFrame) -> DataFrame:
    """The order-dependent resolver, one case per group: (case_id, seq, name, entity_type,
    phones, vehicles, context) to (case_id, seq, key, confidence, status). Anchors first, then the most
    similar name: 96, or 90 with a shared context, joins; 75 waits for review as a node of its own."""
    from ..functions.similarity import token_set_ratio

    def run(pdf):
        import pandas as pd

        known, out = [], []
        for r in pdf.sort_values("seq").itertuples(index=False):
            phones, cars, name = set(r.phones), set(r.vehicles), (r.name or "").lower()
            same = [c for c in known if c["type"] == r.entity_type]
            hit = next((c for c in same if phones & c["phones"] or cars & c["vehicles"]), None)
            status, confidence = "MERGED", 0.95
            if hit is None and same:
                best = max(same, key=lambda c: token_set_ratio(name, c["name"]))
                score = token_set_ratio(name, best["name"])
                if score >= 90 and (r.context in best["contexts"] or score >= 96):
                    hit, confidence = best, 0.70 + 0.28 * score / 100
                elif score >= 75:
                    status, confidence = "PENDING_REVIEW", 0.6 * score / 100
            if hit is None:
                if status == "MERGED":
                    status, confidence = "NEW", 0.85 if phones or cars else 0.65
                hit = {"key": f"{r.entity_type}-{len(known) + 1}", "type": r.entity_type, "name": name, "phones": set(), "vehicles": set(), "contexts": set()}
                known.append(hit)
            hit["phones"] |= phones
            hit["vehicles"] |= cars
            hit["contexts"].add(r.context)
            out.append((r.case_id, r.seq, hit["key"], confidence, status))
        return pd.DataFrame(out, columns=["case_id", "seq", "key", "confidence", "status"])

    return mentions.groupBy("case_id").applyInPandas(run, "case_id string, seq long, key string, confidence double, status string")
