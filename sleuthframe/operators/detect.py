"""Rule detectors (P1-P4) and statistical detectors (A1-A4) over enriched edges, and the
store of findings. All take edges of any number of cases and keep case_id in every key.

A finding is (case_id, rule_id, entity_ids, explanation, evidence, score, severity) and the
figures of its rule. Evidence is an array of (edge_id, source_type, reference, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SEVERITY, Detection
from ..functions import scalars as S
from .cycles import cycle_sets
from .edges import both_ends, floor_days, micros


CORE = ("case_id", "rule_id", "entity_ids", "explanation", "evidence", "score", "severity")


def proof(source_type: str, reference, detail, edge_id=None) -> Column:
    """One piece of evidence; ``reference`` is the edge itself where it is an edge."""
    text = lambda c: F.coalesce(S._c(c).cast("string"), F.lit(""))
    edge = F.lit("") if edge_id is None else text(edge_id)
    return F.struct(edge.alias("edge_id"), F.lit(source_type).alias("source_type"), text(reference).alias("reference"), text(detail).alias("detail"))


def _finding(df: DataFrame, rule: str, ids: Column, explanation: Column, evidence: Column, score: Column, *more: str) -> DataFrame:
    score = S.clamp(score, 0.0, 1.0)
    severity = F.lit(SEVERITY[rule]) if rule in SEVERITY else S.severity(score)
    return df.select("case_id", F.lit(rule).alias("rule_id"), ids.alias("entity_ids"), explanation.alias("explanation"), evidence.alias("evidence"), score.alias("score"), severity.alias("severity"), *more)


def circular_flow(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """P1: directed cycles of transfers within the window, one per set of nodes, with the least
    legs from its least node on and the number of cycles."""
    legs = edges.where("is_txn").select("case_id", F.col("source_id").alias("u"), F.col("target_id").alias("v"), micros("ts").alias("t"), "id")
    best = cycle_sets(legs, cfg.cycle_min, cfg.cycle_max, (cfg.cycle_days + 1) * 86_400_000_000)
    best = best.withColumns({"length": F.size("ids"), "low": F.timestamp_micros("low"), "high": F.timestamp_micros("high")})
    best = best.withColumn("span_days", F.coalesce(floor_days("low", "high"), F.lit(0)))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("no date"))
    text = F.format_string("Money went round %s between %s and %s: %d parties within %d days (limit %d)", F.array_join("ids", ", "), day("low"), day("high"), "length", "span_days", F.lit(cfg.cycle_days))
    evidence = F.transform("legs", lambda e: proof("BANK_TXN", e, F.lit("leg of the cycle"), e))
    return _finding(best, "P1_circular_flow", F.col("ids"), text, evidence, 0.7 + 0.1 * F.col("length"), "length", "span_days", "legs", "instances")


def burner_hub(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """P2: many call peers within a short life."""
    met = both_ends(edges.where("is_call")).groupBy("case_id", "node", "peer").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    g = met.groupBy("case_id", "node").agg(F.count("*").alias("peers"), F.min("low").alias("low"), F.max("high").alias("high"))
    g = g.withColumn("span_days", F.coalesce(floor_days("low", "high"), F.lit(0))).where((F.col("peers") >= cfg.hub_peers) & (F.col("span_days") <= cfg.hub_days))
    # Peers are listed for the hubs alone, whose number of days is bounded.
    who = met.join(g.select("case_id", "node"), ["case_id", "node"], "left_semi").groupBy("case_id", "node").agg(F.array_sort(F.collect_list("peer")).alias("who"))
    g = g.join(who, ["case_id", "node"])
    text = F.format_string("%s calls %d parties within %d days (at least %d within %d); it is kept apart and not merged", "node", "peers", "span_days", F.lit(cfg.hub_peers), F.lit(cfg.hub_days))
    evidence = F.transform("who", lambda p: proof("CDR", p, F.concat("node", F.lit("<->"), p)))
    return _finding(g, "P2_burner_hub", F.concat(F.array("node"), F.col("who")), text, evidence, 0.6 + 0.08 * F.col("peers"), "node", "peers", "span_days")


def call_then_transfer(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """P3: calls followed by a transfer of the same pair, each matched to the first later one
    (an as-of join forward, as a range frame over the pair)."""
    pair = edges.where((F.col("is_call") | F.col("is_txn")) & F.col("ts").isNotNull()).select("case_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "id", "ts", micros("ts").alias("m"), "is_call", (F.col("is_txn") & ~F.col("is_call")).alias("txn"))
    ahead = W.partitionBy("case_id", "a", "b").orderBy("m").rangeBetween(1, cfg.follow_hours * 3_600_000_000)
    hits = pair.withColumn("then", F.min(F.when(F.col("txn"), F.struct("m", "id", "ts"))).over(ahead)).where("is_call and then is not null")
    gap = (F.min(F.col("then.m") - F.col("m")) / 3.6e9).alias("least_gap_hours")
    each = F.array_sort(F.collect_list(F.struct("m", "id", "ts", F.col("then.id").alias("then_id"), F.col("then.ts").alias("then_ts"))))
    g = hits.groupBy("case_id", "a", "b").agg(F.count("*").alias("hits"), gap, each.alias("each")).where(F.col("hits") >= cfg.follow_hits)
    call, then = (lambda h: F.date_format(h["ts"], "yyyy-MM-dd")), (lambda h: F.date_format(h["then_ts"], "yyyy-MM-dd"))
    both = lambda h: F.array(proof("CDR", h["id"], F.concat(F.lit("call on "), call(h), F.lit(", transfer on "), then(h)), h["id"]), proof("BANK_TXN", h["then_id"], F.concat(F.lit("transfer on "), then(h), F.lit(" after a call on "), call(h)), h["then_id"]))
    text = F.format_string("%s and %s: %d calls, each with a transfer within %d hours (at least %d)", "a", "b", "hits", F.lit(cfg.follow_hours), F.lit(cfg.follow_hits))
    return _finding(g, "P3_call_then_transfer", F.array("a", "b"), text, F.flatten(F.transform("each", both)), 0.4 + 0.15 * F.col("hits"), "a", "b", "hits", "least_gap_hours")


def median_of(values: Column) -> Column:
    """Median of an array, the mean of the middle two."""
    s = F.array_sort(values)
    n = F.size(s)
    at = lambda k: F.try_element_at(s, k.cast("int")).cast("double")
    return (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2


def comm_burst(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """P4: a pair's day of calls against the counts of its days before the window. Days of a
    pair are few, so a pair is one array and its windows are explored in place."""
    calls = edges.where("is_call and ts is not null").groupBy("case_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.to_date("ts").alias("day")).agg(F.count("*").cast("int").alias("n"))
    pairs = calls.groupBy("case_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days")).where(F.size("days") > cfg.burst_days)
    counts = F.transform("days", lambda d: d["n"])
    each = pairs.withColumn("counts", counts).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("days") - cfg.burst_days)))
    each = each.withColumn("base", F.when(F.col("i") == 0, F.slice("counts", 1, 1)).otherwise(F.slice("counts", F.lit(1), F.col("i"))))
    each = each.withColumn("median", median_of(F.col("base"))).withColumn("mad", median_of(F.transform("base", lambda x: F.abs(x - F.col("median")))))
    each = each.withColumn("d", F.explode(F.slice("days", F.col("i") + 1, F.lit(cfg.burst_days)))).select("case_id", "a", "b", "i", "base", "median", "mad", F.col("d.day").alias("day"), F.col("d.n").alias("calls"))
    each = each.withColumn("z", S.robust_z("calls", "median", "mad")).where((F.col("z") >= cfg.burst_z) & ~((F.size(F.array_distinct("base")) <= 1) & (F.col("calls") <= F.col("base")[0] + 1)))
    best = each.groupBy("case_id", "a", "b").agg(F.max_by(F.struct("day", "calls", "z", "median"), F.struct("z", -F.col("i"), -F.unix_date("day"))).alias("m")).select("case_id", "a", "b", "m.*")
    best = best.withColumn("times", F.col("calls") / F.when(F.col("median") == 0, 1.0).otherwise(F.col("median")))
    day = F.date_format("day", "yyyy-MM-dd")
    text = F.format_string("%s and %s had %.1f times their usual calls on %s (robust z=%.1f, at least %.1f, in windows of %d active days)", "a", "b", "times", day, "z", F.lit(cfg.burst_z), F.lit(cfg.burst_days))
    evidence = F.array(proof("CDR", F.concat_ws("|", "a", "b", day), F.format_string("%d calls on %s", "calls", day)))
    return _finding(best, "P4_comm_burst", F.array("a", "b"), text, evidence, 0.5 + 0.05 * F.col("z"), "a", "b", "day", "calls", "z", "times")


def _counted(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, value, times): how often each key has a value."""
    return df.groupBy(*keys, value.cast("double").alias("value")).agg(F.count("*").alias("times"))


def _middle(counts: DataFrame, keys: list[str], median: str, n: str) -> DataFrame:
    """Median of each key and the number of its values, from running counts. A key's distinct
    values are sorted, which spills; none are gathered in an aggregate's memory."""
    by = W.partitionBy(*keys)
    upto = F.sum("times").over(by.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "total": F.sum("times").over(by)})
    at = lambda k: F.min(F.when(F.col("upto") >= F.floor((F.col("total") + k) / 2), F.col("value")))
    return ranked.groupBy(*keys).agg(((at(1) + at(2)) / 2).alias(median), F.max("total").alias(n))


def _spread(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Median and MAD of each key; the rows are read once, into counts of values."""
    counts = _counted(df, keys, F.col(value))
    middle = _middle(counts, keys, f"{prefix}_median", f"{prefix}_n")
    off = counts.join(middle, keys).select(*keys, F.abs(F.col("value") - F.col(f"{prefix}_median")).alias("value"), "times")
    return middle.join(_middle(off, keys, f"{prefix}_mad", "off_n").drop("off_n"), keys)


def _baseline(df: DataFrame, spread: DataFrame, whole: DataFrame, cfg: Detection) -> DataFrame:
    """The entity's own baseline where it has enough observations, else the case's."""
    out = df.join(spread, ["case_id", "node"]).join(whole, "case_id")
    own = F.col("own_n") >= cfg.own_baseline
    return out.withColumns({"median": F.when(own, F.col("own_median")).otherwise(F.col("case_median")), "mad": F.when(own, F.col("own_mad")).otherwise(F.col("case_mad")), "fallback": ~own})


def amount_outlier(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """A1: a transfer far above an entity's usual amounts (in whole units)."""
    sums = edges.where("is_txn and amount is not null").select("case_id", "id", "source_id", "target_id", "amount", F.bround("amount", 0).alias("whole"))
    rows = both_ends(sums).select("case_id", "node", "id", "amount", "whole")
    judged = _baseline(rows, _spread(rows, ["case_id", "node"], "whole", "own"), _spread(sums, ["case_id"], "whole", "case"), cfg)
    judged = judged.withColumn("z", S.robust_z("whole", "median", "mad")).where(F.col("z") >= cfg.amount_z).withColumn("s", S.score_for_z("z"))
    best = judged.groupBy("case_id", "node").agg(F.min_by(F.struct("id", "amount", "z", "median", "s", "fallback"), F.struct(-F.col("s"), F.col("id"))).alias("m")).select("case_id", "node", "m.*")
    best = best.withColumn("times", F.col("amount") / F.when(F.col("median") == 0, 1.0).otherwise(F.col("median")))
    base = F.when(F.col("fallback"), "the case-wide fallback baseline").otherwise("the entity's own baseline")
    text = F.format_string("%s transfer is %.1f times the usual amount (z=%.1f, at least %.1f) against %s", S.fmt_inr("amount"), "times", "z", F.lit(cfg.amount_z), base)
    evidence = F.array(proof("BANK_TXN", "id", F.format_string("%s z=%.1f", S.fmt_inr("amount"), "z"), "id"))
    return _finding(best, "A1_amount_outlier", F.array("node"), text, evidence, F.col("s"), "node", F.col("id").alias("edge_id"), "amount", "z", "fallback")


def volume_spike(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """A2: an entity's busiest day of calls against its active days."""
    days = both_ends(edges.where("is_call and ts is not null")).groupBy("case_id", "node", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    peak = days.groupBy("case_id", "node").agg(F.max_by(F.struct("day", "n"), F.struct("n", -F.unix_date("day"))).alias("p")).select("case_id", "node", "p.day", F.col("p.n").alias("peak")).where(F.col("peak") >= cfg.volume_peak)
    judged = _baseline(peak, _spread(days, ["case_id", "node"], "n", "own"), _spread(days, ["case_id"], "n", "case"), cfg)
    judged = judged.withColumn("z", S.robust_z("peak", "median", "mad")).where(F.col("z") >= cfg.volume_z)
    base = F.when(F.col("fallback"), "the case-wide fallback baseline").otherwise("the entity's own baseline")
    text = F.format_string("%d calls on %s against a median of %.1f a day (robust z=%.1f, at least %.1f): %s", "peak", F.date_format("day", "d-MMM"), "median", "z", F.lit(cfg.volume_z), base)
    day = F.date_format("day", "yyyy-MM-dd")
    evidence = F.array(proof("CDR", F.concat_ws("|", "node", day), F.format_string("%d calls on %s", "peak", day)))
    return _finding(judged, "A2_volume_spike", F.array("node"), text, evidence, S.score_for_z("z"), "node", "day", "peak", "z", "fallback")


def counterparty_expansion(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """A3: new counterparties in the last days against the weekly habit."""
    seen = both_ends(edges.where("is_call or is_txn")).groupBy("case_id", "node", "peer").agg(F.min("ts").alias("t")).where("t is not null")
    last = seen.groupBy("case_id", "node").agg(F.max("t").alias("latest"), F.min("t").alias("earliest"), F.count("*").alias("dated"))
    cut = F.expr(f"latest - interval {cfg.expand_days} days")
    weekly = lambda n, days: n / F.greatest(F.lit(1.0), F.when(days == 0, 1).otherwise(days) / 7.0)
    rates = _counted(last.where("dated >= 2"), ["case_id"], weekly(F.col("dated"), floor_days("earliest", "latest")))
    case = _middle(rates, ["case_id"], "case_rate", "case_n").drop("case_n")
    g = seen.join(last.withColumn("cut", cut), ["case_id", "node"]).groupBy("case_id", "node", "cut", "earliest").agg(F.count_if(F.col("t") >= F.col("cut")).alias("fresh"), F.count_if(F.col("t") < F.col("cut")).alias("before"))
    g = g.join(case, "case_id", "left").where(F.col("fresh") >= cfg.expand_new)
    own = weekly(F.col("before"), floor_days("earliest", "cut"))
    g = g.withColumns({"fallback": F.col("before") < 2, "typical": F.greatest(F.lit(0.5), F.when(F.col("before") >= 2, own).otherwise(F.coalesce("case_rate", F.lit(1.0))))}).where(F.col("fresh") >= cfg.expand_times * F.col("typical"))
    base = F.when(F.col("fallback"), "case-wide fallback baseline").otherwise("own baseline")
    text = F.format_string("%d new contacts in %d days against %.1f a week (%s)", "fresh", F.lit(cfg.expand_days), "typical", base)
    evidence = F.array(proof("CDR", F.concat("node", F.lit(f"|new-{cfg.expand_days}d")), F.format_string("%d new peers in %d days", "fresh", F.lit(cfg.expand_days))))
    return _finding(g, "A3_counterparty_expansion", F.array("node"), text, evidence, 0.4 + 0.06 * F.col("fresh") + 0.02 * (F.col("fresh") / F.col("typical")), "node", "fresh", "typical", "fallback")


def odd_hour(edges: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """A4: a large share of activity at night against the case's share."""
    ends = both_ends(edges.where("(is_call or is_txn) and ts is not null")).select("case_id", "node", ((F.hour("ts") >= cfg.odd_from) & (F.hour("ts") < cfg.odd_to)).alias("odd"))
    g = ends.groupBy("case_id", "node").agg(F.count("*").alias("total"), F.count_if("odd").alias("odd"))
    case = g.groupBy("case_id").agg((F.sum("odd") / F.sum("total")).alias("case_ratio"))
    g = g.join(case, "case_id").withColumn("ratio", F.col("odd") / F.col("total")).where((F.col("total") >= cfg.odd_total) & (F.col("ratio") >= cfg.odd_ratio))
    g = g.where((F.col("ratio") >= cfg.odd_times * F.greatest("case_ratio", F.lit(0.01))) | (F.col("ratio") >= 0.5))
    strength = F.when(F.col("case_ratio") <= 0, F.col("ratio") * 10).otherwise(F.col("ratio") / F.greatest("case_ratio", F.lit(0.02)))
    hours = f"{cfg.odd_from:02d}-{cfg.odd_to:02d}h"
    text = F.format_string("%.0f%% of %d events fall in %s, in the case %.0f%%", F.col("ratio") * 100, "total", F.lit(hours), F.col("case_ratio") * 100)
    evidence = F.array(proof("CDR", F.concat("node", F.lit("|odd-hour")), F.format_string("%d of %d in %s", "odd", "total", F.lit(hours))))
    return _finding(g, "A4_odd_hour_activity", F.array("node"), text, evidence, 0.4 + 0.1 * strength, "node", "odd", "total", "ratio", "case_ratio")


DETECTORS = {"P1": circular_flow, "P2": burner_hub, "P3": call_then_transfer, "P4": comm_burst, "A1": amount_outlier, "A2": volume_spike, "A3": counterparty_expansion, "A4": odd_hour}


def scan(edges: DataFrame, cfg: Detection = Detection(), which=tuple(DETECTORS), detected_at: Column | None = None) -> DataFrame:
    """The findings of all detectors in one pass over the same edges, open, each under the id
    case:rule:hash of its entities."""
    out = reduce(DataFrame.unionByName, [DETECTORS[d](edges, cfg).select(*CORE) for d in which])
    out = out.withColumns({"entity_set_hash": S.set_hash("entity_ids"), "status": F.lit("open"), "detected_at": F.current_timestamp().cast("timestamp_ntz") if detected_at is None else detected_at})
    return out.withColumn("id", F.concat_ws(":", "case_id", "rule_id", "entity_set_hash"))


def new_findings(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings whose case, rule and entities are not stored, whatever became of those."""
    keys = ["case_id", "rule_id", "entity_set_hash"]
    return found.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*found.columns)


def list_findings(stored: DataFrame, case_id: str, status: str | None = None) -> DataFrame:
    """A case's findings by time; those of one status by severity, as text, and time."""
    own = stored.where(F.col("case_id") == case_id)
    return own.orderBy("detected_at", "id") if status is None else own.where(F.col("status") == status).orderBy("severity", "detected_at", "id")


def set_status(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after changes (id, status). A status that is none of the three known ones
    and an id that is not stored are errors when the snapshot is read."""
    known = F.col("status").isin("open", "confirmed", "dismissed")
    checked = changes.select("id", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), "status"))).alias("_s"))
    out = stored.withColumn("_there", F.lit(True)).join(checked, "id", "full")
    there = F.when(F.col("_there"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no finding "), "id")))
    return out.withColumns({"id": there, "status": F.coalesce("_s", "status")}).select(*stored.columns)
