"""The analytics on small literal cases with hand-computed results."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sleuthframe.functions import scalars as S
from sleuthframe.functions.similarity import name_similarity, token_set_ratio
from sleuthframe.operators import audit, detect, edges, extract, graph, resolve, risk, state
from sleuthframe.sources import adapters, loaders

EDGE = "case_id string, id string, source_id string, target_id string, relation_type string, confidence_score double, evidence_source string, status string, details string"


def make(spark, rows):
    out = []
    for k, (s, t, rel, ts, amount) in enumerate(rows):
        detail = f'{{"timestamp":"{ts.isoformat()}"' + (f',"amount":{amount}' if amount is not None else "") + "}" if ts else None
        out.append(("C", f"e{k:04d}", s, t, rel, 0.9, "", "PENDING", detail))
    return edges.enrich(spark.createDataFrame(out, EDGE))


def at(day, hour=10, month=6):
    return dt.datetime(2023, month, 1) + dt.timedelta(days=day, hours=hour)


def test_circular_flow(spark):
    rows = [("A", "B", "TRANSFER", at(0), 1.0), ("B", "C", "TRANSFER", at(5), 1.0), ("C", "A", "TRANSFER", at(10), 1.0), ("X", "Y", "TRANSFER", at(0), 1.0), ("Y", "Z", "TRANSFER", at(1), 1.0), ("Z", "X", "TRANSFER", at(60), 1.0), ("A", "A", "TRANSFER", at(1), 1.0)]
    got = detect.circular_flow(make(spark, rows)).collect()
    assert [(r.entity_ids, r.span_days, r.score, r.severity) for r in got] == [(["A", "B", "C"], 10, 1.0, "high")]
    assert [(x.edge_id, x.source_type) for x in got[0].evidence] == [(x, "BANK_TXN") for x in got[0].legs]


def test_many_transfers_between_few_parties(spark):
    """300 transfers for each of five legs make 300^5 cycles of one set."""
    rows = [(f"P{k}", f"P{(k + 1) % 5}", "TRANSFER", at(0, hour), 1.0) for k in range(5) for hour in range(300)]
    got = detect.circular_flow(make(spark, rows)).collect()
    assert [(r.entity_ids, r.span_days, r.instances, r.legs) for r in got] == [([f"P{k}" for k in range(5)], 0, 300**5, [f"e{300 * k:04d}" for k in range(5)])]


def test_cycles_by_brute_force(spark, monkeypatch):
    """Cycles of transfers, some without a time and some of one id, against every path listed."""
    import random

    import numpy as np

    from sleuthframe.operators import cycles

    def listed(edges, least, most, width):
        out, by = {}, {}
        for e in edges:
            by.setdefault(e[0], []).append(e)

        def go(path, legs):
            for e in by.get(path[-1], []):
                own = [*legs, e]
                ts = [x[2] for x in own if x[2] is not None]
                if ts and max(ts) - min(ts) >= width:
                    continue
                if e[1] == path[0] and least <= len(own) <= most:
                    key = ([x[3] for x in own], (min(ts), max(ts)) if ts else (-(10**9), -(10**9)))
                    seen = out.setdefault(tuple(sorted(path)), [key, 0])
                    seen[:] = min(seen[0], key), seen[1] + 1
                elif e[1] > path[0] and e[1] not in path and len(own) < most:
                    go([*path, e[1]], own)

        for u in by:
            go([u], [])
        return {k: (*v[0], v[1]) for k, v in out.items()}

    def drawn(rng, n, m, span, alike, unknown):
        ids = [f"e{rng.randrange(6) if alike else k:03d}" for k in range(m)]
        rng.shuffle(ids)
        return [(*rng.sample([f"N{k}" for k in range(n)], 2), None if rng.random() < unknown else rng.randrange(-span, span), i) for i in ids]

    def merged(rows):
        out = {}
        for r in rows:
            key = (r["legs"], (r["low"], r["high"]) if r["low"] is not None else (-(10**9), -(10**9)))
            seen = out.setdefault(tuple(r["ids"]), [key, 0])
            seen[:] = min(seen[0], key), seen[1] + r["instances"]
        return {k: (*v[0], v[1]) for k, v in out.items()}

    rng, sets = random.Random(3), 0
    for _ in range(150):
        edges, width, most = drawn(rng, rng.choice([3, 5, 8]), rng.choice([20, 40]), rng.choice([5, 50]), rng.random() < 0.4, 0), rng.choice([3, 10, 40]), rng.choice([3, 4])
        monkeypatch.setattr(cycles, "HELD", rng.choice([2, 10, 500_000]))
        monkeypatch.setattr(cycles, "STARTS", rng.choice([1, 3, 62]))
        rows = []
        for part in range(2):
            held = cycles.Slice([e[0] for e in edges], [e[1] for e in edges], np.array([e[2] for e in edges]), [e[3] for e in edges], width)
            held.scan(-100, 100, 2, most, part, 2)
            rows += [r for b in held.batches("C") for r in b.to_pylist()]
        want = listed(edges, 2, most, width)
        sets += len(want)
        assert merged(rows) == want
    assert sets > 300
    monkeypatch.undo()
    for alike in (False, True):
        edges = drawn(rng, 6, 60, 30, alike, 0.1)
        df = spark.createDataFrame([("C", *e) for e in edges], "case_id string, u string, v string, t long, id string")
        want = listed(edges, 3, 4, 8)
        assert merged(r.asDict() for r in cycles.cycle_sets(df, 3, 4, 8, windows=2, heavy=20).collect()) == want and len(want) > 5


def test_hub_and_follow(spark):
    rows = [("H", f"P{k}", "CALLED", at(4 * k), None) for k in range(5)]
    assert [(r.node, r.peers, r.span_days, r.score) for r in detect.burner_hub(make(spark, rows)).collect()] == [("H", 5, 16, 1.0)]
    rows = [x for k in range(3) for x in (("A", "B", "CALLED", at(5 * k, 9), None), ("B", "A", "TRANSFER", at(5 * k, 39), 5.0))]
    got = detect.call_then_transfer(make(spark, rows)).collect()
    assert [(r.entity_ids, r.hits, round(r.score, 2), r.least_gap_hours) for r in got] == [(["A", "B"], 3, 0.85, 30.0)]


def test_burst_and_spike(spark):
    rows = [("A", "B", "CALLED", at(k), None) for k in range(14)] + [("A", "B", "CALLED", at(14, 8 + k / 10), None) for k in range(8)] + [("Q", "R", "CALLED", at(k), None) for k in range(21)]
    e = make(spark, rows)
    got = detect.comm_burst(e).collect()
    assert [(r.entity_ids, r.calls, r.z, r.times, round(r.score, 2)) for r in got] == [(["A", "B"], 8, 7.0, 8.0, 0.85)]
    assert sorted((r.node, r.peak, r.z, round(r.score, 2)) for r in detect.volume_spike(e).collect()) == [("A", 8, 7.0, 0.96), ("B", 8, 7.0, 0.96)]


def test_amounts(spark):
    rows = [("S", f"T{k}", "TRANSFER", at(k), 10000.0 + 500 * k) for k in range(6)] + [("S", "T9", "TRANSFER", at(9), 500000.0), ("N", "T1", "TRANSFER", at(2), 11000.0)]
    got = {r.node: r for r in detect.amount_outlier(make(spark, rows)).collect()}
    assert got["S"].z == pytest.approx(0.6745 * 488500 / 1000, rel=1e-9) and got["S"].score == 1.0 and not got["S"].fallback and got["T9"].fallback


def test_expansion_and_hours(spark):
    rows = [("S", f"P{k}", "CALLED", at(-d), None) for k, d in enumerate((90, 75, 60, 50))] + [("S", f"N{k}", "CALLED", at(0, 20 + k), None) for k in range(9)]
    assert [(r.node, r.fresh, r.typical, r.fallback) for r in detect.counterparty_expansion(make(spark, rows)).collect()] == [("S", 9, 0.5, False)]
    rows = [("N", f"P{k}", "CALLED", at(k, 2 if k < 8 else 12), None) for k in range(11)] + [("X", "Y", "CALLED", at(k % 30, 12), None) for k in range(96)]
    got = detect.odd_hour(make(spark, rows)).collect()
    assert [(r.node, r.odd, r.total, r.score) for r in got] == [("N", 8, 11, 1.0)]


def test_findings_store(spark):
    e = make(spark, [("H", f"P{k}", "CALLED", at(4 * k), None) for k in range(5)])
    found = spark.createDataFrame(detect.scan(e).collect(), detect.scan(e).schema)
    assert found.count() == 1 and detect.new_findings(found, found).count() == 0
    rows = found.withColumn("id", F.lit("f1"))
    assert detect.set_status(rows, spark.createDataFrame([("f1", "dismissed")], "id string, status string")).first().status == "dismissed"
    assert [r.evidence[0].detail for r in found.collect()] == ["H<->P0"] and found.first().id.startswith("C:P2_burner_hub:")
    assert detect.list_findings(rows, "C", "open").count() == 1 and detect.list_findings(rows, "C", "dismissed").count() == 0
    with pytest.raises(Exception, match="no finding"):
        detect.set_status(rows, spark.createDataFrame([("f2", "open")], "id string, status string")).collect()
    with pytest.raises(Exception, match="unknown status"):
        detect.set_status(rows, spark.createDataFrame([("f1", "gone")], "id string, status string")).collect()


def test_event_fields(spark):
    df = spark.createDataFrame([("seen 2023-05-01 10:20 for Rs. 1,250.50", None), ("", '{"timestamp":"2023-05-01T10:20:00Z","amt":"7"}'), ("none", "not json"), (None, None)], "evidence string, details string")
    got = df.select(edges.event_ts(F.col("evidence"), F.col("details")).alias("t"), edges.amount_of(F.col("evidence"), F.col("details")).alias("a")).collect()
    assert [(r.t, r.a) for r in got] == [(dt.datetime(2023, 5, 1, 10, 20), 1250.5), (dt.datetime(2023, 5, 1, 10, 20), 7.0), (None, None), (None, None)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalisers(spark):
    for raw, want in (("+91-98765 43210", "9876543210"), ("09876543210", "9876543210"), ("12345", ""), (None, ""), ("00919876543210", "9876543210")):
        assert one(spark, S.normalize_phone(F.lit(raw).cast("string"))) == want
    assert one(spark, S.normalize_vehicle(F.lit("dl-01-ab-4402"))) == "DL01AB4402"
    assert one(spark, S.name_variants(F.lit("Shri R. Kumar"))) == ["kumar", "r kumar"]
    assert one(spark, S.mask_phone(F.lit("+91-9876543210"))) == "+91-******10" and one(spark, S.mask_name(F.lit("Ravi  K"))) == "R*** K***" and one(spark, S.mask_name(F.lit("R"))) == "***"
    assert one(spark, S.split_multi(F.lit("a| b;;c,"))) == ["a", "b", "c"]
    assert one(spark, S.fmt_inr(F.lit(1234567.5))) == "₹1,234,568"
    assert one(spark, S.normalize_ts(F.lit("2023-01-02 03:04:05"))) == "2023-01-02T03:04:05+00:00" and one(spark, S.normalize_ts(F.lit("noon"))) == "noon"
    assert one(spark, S.paragraphs(F.lit("One. Two\n\nthree"))) == ["One.", "Two", "three"]


@pytest.mark.parametrize(("a", "b", "want"), [("ramesh kumar", "ramesh khanna", 72.0), ("vikram rana", "vikram rathore", 72.0), ("vikram singh rathore", "vikram rathore", 100.0), ("", "x", 0.0)])
def test_token_set_ratio(a, b, want):
    assert token_set_ratio(a, b) == pytest.approx(want)


@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_ratio_is_symmetric(a, b):
    assert token_set_ratio(a, b) == pytest.approx(token_set_ratio(b, a)) and 0 <= token_set_ratio(a, b) <= 100


PERSON = "case_id string, id string, name string, aliases array<string>, phone_numbers array<string>, entity_type string, base_risk_score double"


def test_resolution(spark):
    p = [("C", "1", "R. Kumar", [], ["+91-98765 43210"], "PERSON", 50.0), ("C", "2", "Ramesh Kumar", [], ["9876543210"], "PERSON", 60.0), ("C", "3", "Ramesh Khanna", [], ["9876543210"], "PERSON", 10.0), ("C", "4", "Zara Khan", [], ["9876543210"], "PERSON", 1.0), ("C", "5", "Chandrashekhar Venkataraman", [], [], "PERSON", 1.0), ("C", "6", "Chandrashekhar Venkataraman", [], [], "PERSON", 1.0)]
    people = spark.createDataFrame(p, PERSON)
    pairs = resolve.classify_pairs(people)
    rules = {(r.a, r.b): r.rule for r in pairs.collect()}
    assert rules["1", "2"] == "auto_r1" and rules["2", "3"] == "review_r3" and rules["1", "4"] == "separate_r4" and rules["5", "6"] == "review_r5"
    mapping = resolve.merge_map(pairs)
    assert {(r.id, r.survivor) for r in mapping.collect()} == {("1", "1"), ("2", "1")}
    e = spark.createDataFrame([("C", "x", "2", "3", "CALLED"), ("C", "y", "1", "2", "CALLED"), ("C", "z", "3", "4", "CALLED")], "case_id string, id string, source_id string, target_id string, relation_type string")
    merged, moved, log = resolve.merge_entities(people, e, mapping)
    assert {r.id for r in merged.collect()} == {"1", "3", "4", "5", "6"} and {(r.id, r.source_id) for r in moved.collect()} == {("x::2->1", "1"), ("z", "3")}
    back, old = resolve.unmerge(merged, moved, e, log)
    assert {r.id for r in back.collect()} == set("123456") and {r.id for r in old.collect()} == {"x", "y", "z"}
    nodes, uses = resolve.shared_phone_nodes(pairs)
    assert [r.id for r in nodes.collect()] == ["PHONE-9876543210"] and uses.count() >= 2
    q = resolve.review_queue(pairs)
    first = q.first()
    assert resolve.decide(q, spark.createDataFrame([(first.id, "rejected")], "id string, decision string")).where("decision = 'rejected'").count() == 1
    alias = spark.createDataFrame([("C", "1", "Vikram Rana", ["Vikram Singh Rathore"], ["9876500000"], "PERSON", 1.0), ("C", "2", "Vikram S. Rathore", [], ["9876500000"], "PERSON", 1.0)], PERSON)
    assert [r.rule for r in resolve.alias_pairs(alias).collect()] == ["auto_alias"] and [r.rule for r in resolve.classify_pairs(alias).collect()] == ["review_r3"]
    mentions = spark.createDataFrame([("C", 1, "Amit Verma", "PERSON", ["1"], [], "a"), ("C", 2, "A. Verma", "PERSON", ["1"], [], "b"), ("C", 3, "Amit Verma", "PERSON", [], [], "a"), ("C", 4, "Zed Quux", "PERSON", [], [], "a")], "case_id string, seq long, name string, entity_type string, phones array<string>, vehicles array<string>, context string")
    assert [r.key for r in resolve.greedy_resolver(mentions).orderBy("seq").collect()] == ["PERSON-1", "PERSON-1", "PERSON-1", "PERSON-2"]
    assert name_similarity("R. Kumar", "Ramesh Kumar") >= 85


def test_unmerge_leaves_other_merges(spark):
    p = [("C", k, "Name " + k, [], [], "PERSON", 1.0) for k in "12349"]
    people = spark.createDataFrame(p, PERSON)
    mapping = spark.createDataFrame([("C", "1", "1"), ("C", "2", "1"), ("C", "3", "3"), ("C", "4", "3")], "case_id string, id string, survivor string")
    e = spark.createDataFrame([("C", "x", "2", "9", "CALLED"), ("C", "y", "4", "9", "CALLED")], "case_id string, id string, source_id string, target_id string, relation_type string")
    merged, moved, log = resolve.merge_entities(people, e, mapping)
    back, old = resolve.unmerge(merged, moved, e, log.where("surviving_entity_id = '1'"))
    assert {r.id for r in back.collect()} == set("1239") and {(r.id, r.source_id) for r in old.collect()} == {("x", "2"), ("y::4->3", "3")}


def test_resolve_case(spark):
    p = [("C", "1", "R. Kumar", [], ["9876543210"], "PERSON", 50.0), ("C", "2", "Ramesh Kumar", [], ["09876543210"], "PERSON", 60.0), ("C", "3", "Ramesh Khanna", [], ["9876543210"], "PERSON", 10.0), ("C", "4", "Zara Quux", [], ["9876543210"], "PERSON", 10.0)]
    people = spark.createDataFrame(p, PERSON)
    e = spark.createDataFrame([("C", "x", "2", "3", "CALLED", 0.9, "PENDING")], "case_id string, id string, source_id string, target_id string, relation_type string, confidence_score double, status string")
    done = resolve.resolve_case(people, e)
    assert {r.id for r in done["entities"].collect()} == {"1", "3", "4", "PHONE-9876543210"}
    assert {r.id for r in done["edges"].collect()} >= {"x::2->1", "4->PHONE-9876543210:USES"}
    q = done["reviews"]
    ask = resolve.pending_reviews(q, "C").where("a = '2' and b = '3'").collect()
    assert len(ask) == 1 and resolve.pending_reviews(q, "D").count() == 0
    decided = resolve.decide(q, spark.createDataFrame([(ask[0].id, "accepted")], "id string, decision string"))
    again = resolve.resolve_case(people, e, reviewed=decided)
    assert {r.id for r in again["entities"].where("entity_type = 'PERSON'").collect()} == {"1", "4"}
    none = spark.createDataFrame([], state.TABLES["entity_sources"])
    new = spark.createDataFrame([("C", "Amit Verma", [], ["9876500000"], "PERSON", 1.0)] * 2, "case_id string, name string, aliases array<string>, phone_numbers array<string>, entity_type string, base_risk_score double")
    refs = new.select("case_id", "entity_type", "name", "phone_numbers", F.lit("fir").alias("source_type"), F.lit("F1").alias("record_id"), F.lit("text").alias("field"), F.lit(0).alias("span_start"), F.lit(4).alias("span_end"), F.lit(1.0).alias("confidence"))
    got = resolve.ingest_canonical(people, e, none, new, refs)
    assert got["entities"].where("name = 'Amit Verma'").count() == 1 and got["sources"].count() == 1


def test_resolution_query_by_brute_force(spark):
    """Every two of the table's people, against the query's pairs."""
    from sleuthframe.functions.similarity import tokens
    from sleuthframe.plans import cases

    folder = "/root/testdata/sf0.001"
    people = sorted((r.id, r.name, r.phone_numbers[0][-10:].replace(" ", "")) for r in cases.resolvable(spark, folder).collect())
    want = {}
    for i, (a, x, p) in enumerate(people):
        for b, y, q in people[i + 1 :]:
            sim, phone = name_similarity(x, y), p == q
            if phone:
                want[a, b] = "auto_r1" if sim >= 85 else "review_r3" if sim >= 60 else "separate_r4"
            elif sim >= 95 and {w for w in tokens(x) if len(w) > 1} & {w for w in tokens(y) if len(w) > 1}:
                want[a, b] = "review_r5"
    got = {(r.a, r.b): r.rule for r in cases.r6_resolve_case(spark, folder).collect()}
    assert got == want and set(want.values()) >= {"auto_r1", "separate_r4", "review_r5"}


def test_signs_lose_no_alike_names():
    """Names of few, often shared words, edited: every two that reach 95 agree in a sign."""
    import random

    from sleuthframe.functions.similarity import name_signs, tokens

    rng = random.Random(5)
    words = ["mohan", "kumar", "k", "lal", "singh", "zed", "christopher", "g", "li", "montgomery"]

    def name():
        out = [rng.choice(words) if rng.random() < 0.8 else "quux" + "".join(rng.choices("12", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        k = rng.randrange(len(out))
        if rng.random() < 0.4:
            at = rng.randrange(len(out[k]) + 1)
            out[k] = out[k][:at] + rng.choice("ab1") + out[k][at:] if rng.random() < 0.5 else out[k][:at] + out[k][at + 1 :] or "x"
        return " ".join(out)

    names = [name() for _ in range(700)]
    long = lambda n: {w for w in tokens(n) if len(w) > 1}
    signs = [name_signs(n, set(tokens(n)), long(n), 0.95) for n in names]
    of = [{k: {(key, cut, size) for kind, key, cut, _, size in s if kind == k} for k in ("wide", "core", "part", "rest")} for s in signs]
    hits = 0
    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            if not long(a) & long(b) or name_similarity(a, b) < 95:
                continue
            hits += 1
            keys = lambda n, k: {x[0] for x in of[n][k]}
            rest = any(k == q and c + d <= (s + z) * 0.05 + 1e-6 for k, c, s in of[i]["rest"] for q, d, z in of[j]["rest"]) if keys(i, "rest") & keys(j, "rest") else False
            assert of[i]["wide"] or of[j]["wide"] or keys(i, "core") & keys(j, "part") or keys(i, "part") & keys(j, "core") or rest, (a, b)
    assert hits > 1000


def test_likely_pairs(spark):
    """A word of many people brings no pair by itself, and every pair that has a rule is there."""
    import random

    rng = random.Random(6)
    names = [f"Zed Quux{k}" for k in range(150)] + ["Zed Quux12", "Zed. Quux 12", "Z. Zed", "Dr Zed Quux7"] + [f"Zed Wilhelmina Anastasia Montgomery{k}" for k in range(20)]
    names += [" ".join(rng.choices(["Ram", "Lal", "Rama", "K.", "Kumar", "Kumarr", "Zed", "Mohan\u00a0Das"], k=rng.randint(1, 4))) for _ in range(80)]
    rows = [("C", f"N{k:03d}", n, [], [f"98765{k // 3 if k % 7 == 0 else k:05d}"], "PERSON", 1.0) for k, n in enumerate(names)]
    people = spark.createDataFrame(rows, "case_id string, id string, name string, aliases array<string>, phone_numbers array<string>, entity_type string, base_risk_score double")
    every = resolve.candidate_pairs(resolve.with_vehicles(people))
    text = {r[1]: r[2] for r in rows}
    phone = {r[1]: r[4][0] for r in rows}
    met = {(r.a, r.b) for r in every.collect()}
    size = lambda n: len([w for w in n.lower().replace(".", " ").split(" ") if w and w != "dr"])
    want = {(a, b) for a, b in met if phone[a] == phone[b] or name_similarity(text[a], text[b]) >= 95 and size(text[a]) >= 2 and size(text[b]) >= 2}
    for common in (1, 50):
        got = {(r.a, r.b) for r in resolve.likely_pairs(resolve.with_vehicles(people), common=common).collect()}
        assert want <= got <= met and len(want) > 300
    ruled = resolve.classify_pairs(people).where("rule is not null")
    assert {(r.a, r.b) for r in ruled.collect()} == want
    assert resolve.classify_pairs(people.where("name like 'Zed Quux%'")).count() < 2000 < 150 * 149 / 2


def seeded(spark):
    day = lambda m, d, h=10: dt.datetime(2023, m, d, h)
    rows = [("P1-A", "P1-B", "TRANSFER", day(7, 5), 250000.0), ("P1-B", "P1-C", "TRANSFER", day(7, 10, 11), 245000.0), ("P1-C", "P1-A", "TRANSFER", day(7, 15, 12), 248000.0)]
    rows += [("P2-HUB", f"P2-P{k + 1}", "CALLED", day(6, 1 + 4 * k), None) for k in range(5)]
    rows += [x for k in (0, 5, 10) for x in (("P3-A", "P3-B", "CALLED", day(7, 1 + k, 9), None), ("P3-A", "P3-B", "TRANSFER", day(7, 2 + k, 15), 11000.0))]
    rows += [("P4-A", "P4-B", "CALLED", day(8, 1 + k), None) for k in range(14)] + [("P4-A", "P4-B", "CALLED", day(8, 15, 9 + k), None) for k in range(8)]
    rows += [("P4-S1", "P4-S2", "CALLED", day(8, 1 + k), None) for k in range(21)]
    return rows


def test_seeded_patterns(spark):
    """The rule detectors' seed: four findings, and the spike that goes with the burst."""
    found = detect.scan(make(spark, seeded(spark))).collect()
    assert {(r.rule_id[:2], r.entity_ids[0]) for r in found} == {("P1", "P1-A"), ("P2", "P2-HUB"), ("P3", "P3-A"), ("P4", "P4-A"), ("A2", "P4-A"), ("A2", "P4-B")}
    by = {r.rule_id[:2]: r for r in found}
    assert by["P1"].score == 1.0 and by["P3"].score == pytest.approx(0.85) and by["P4"].score == pytest.approx(0.85) and by["P2"].entity_ids == ["P2-HUB", *(f"P2-P{k}" for k in range(1, 6))]
    assert all(r.evidence and r.explanation and r.detected_at and r.id == f"C:{r.rule_id}:{r.entity_set_hash}" for r in found)
    assert "z=7.0" in by["P4"].explanation and "16 days" in by["P2"].explanation and len(by["P3"].evidence) == 6


def test_seeded_anomalies(spark):
    day = lambda m, d, h=10: dt.datetime(2023, m, d, h)
    rows = [("A1-S", "A1-B" if k == 5 else f"A1-P{k}", "TRANSFER", day(9, 1 + k), 10000.0 + 500 * k) for k in range(6)] + [("A1-S", "A1-B", "TRANSFER", day(9, 20), 500000.0)]
    rows += [("A2-S", f"A2-P{(k + j) % 9}", "CALLED", day(9, 1 + k, 9 + j), None) for k in range(14) for j in range((2, 3, 4)[k % 3])]
    rows += [("A2-S", f"A2-P{j % 9}", "CALLED", day(9, 15, 8 + j), None) for j in range(12)]
    rows += [("A2-NEW", f"A2-Q{j}", "CALLED", day(9, d, 8 + j), None) for d, n in ((1, 1), (3, 1), (5, 9)) for j in range(n)]
    rows += [("A3-EXP", f"A3-O{k}", "CALLED", day(9, 30) - dt.timedelta(days=d), None) for k, d in enumerate((90, 75, 60, 50))]
    rows += [("A3-EXP", f"A3-N{k}", "CALLED", day(9, 24 + k % 6, 11), None) for k in range(9)]
    rows += [("A4-N", f"A4-P{k % 2 + 1}", "CALLED", day(9, 1 + k, 2 if k < 8 else 14), None) for k in range(11)]
    rows += [("A0-N1", "A0-N2", "CALLED", day(9, 1 + k, 12), None) for k in range(10)] + [("A0-N1", "A0-N2", "TRANSFER", day(8, 3 + k), 11000.0 + 500 * k) for k in range(2)]
    found = detect.scan(make(spark, rows)).collect()
    got = {(r.rule_id[:2], r.entity_ids[0]): r for r in found}
    assert {("A1", "A1-S"), ("A1", "A1-B"), ("A2", "A2-S"), ("A2", "A2-NEW"), ("A3", "A3-EXP"), ("A4", "A4-N")} <= set(got)
    assert not any(x.startswith("A0") for r in found for x in r.entity_ids)
    assert "z=" in got["A1", "A1-S"].explanation and "median" in got["A2", "A2-S"].explanation and "fallback" in got["A2", "A2-NEW"].explanation
    assert "new contacts" in got["A3", "A3-EXP"].explanation and "00" in got["A4", "A4-N"].explanation and got["A1", "A1-S"].evidence[0].source_type == "BANK_TXN"
    assert all(r.evidence and r.severity in ("low", "medium", "high") for r in found)


def test_merge_map_settles_or_raises(spark):
    chain = spark.createDataFrame([("c", f"p{k:02d}", f"p{k + 1:02d}", "auto_r1") for k in range(20)], "case_id string, a string, b string, rule string")
    with pytest.raises(RuntimeError):
        resolve.merge_map(chain, rounds=1)
    assert {x.survivor for x in resolve.merge_map(chain).collect()} == {"p00"}


def test_extraction(spark):
    assert len(extract.anchors("call +91 98765 43210 or 09876543210 or 91-9876543210 ok")) == 3
    assert len(extract.anchors("plates DL-01-AB-4402 and MH 12 CD 3456 seen")) == 2
    docs = spark.createDataFrame([("r1", "Ramesh Kumar driving vehicle DL-01-AB-4402 called +91-9876543210. Then nothing."), ("r2", None)], "record_id string, text string")
    rel = extract.relations(extract.extract(docs), "record_id")
    assert {(r.relation, r.b_type) for r in rel.collect()} >= {("USES", "phone"), ("USES", "vehicle"), ("ASSOCIATED_WITH", "phone")}
    runs = spark.createDataFrame([], "run_key string")
    out = extract.ingest_text(docs.where("text is not null"), runs, "C", "fir")
    assert out["nodes"].count() == 3 and out["spans"].where("span_start is null").count() == 0 and out["edges"].count() >= 4
    assert extract.ingest_text(docs.where("text is not null"), out["runs"], "C", "fir")["nodes"].count() == 0
    hindi = extract.extract_columns(spark.createDataFrame([("थाना: सदर बाज़ार में रमेश कुमार",)], "text string")).first()
    assert hindi.locations and hindi.persons


def test_graph(spark):
    e = make(spark, [("A", "B", "TRANSFER", at(0), 1.0), ("B", "C", "TRANSFER", at(1), 1.0), ("C", "A", "TRANSFER", at(2), 1.0), ("C", "D", "CALLED", at(3), None)])
    v, g = graph.build_graph(e.select("case_id", F.col("source_id").alias("id")), e)
    rank = {r.id: r.pagerank for r in graph.pagerank(v, g).collect()}
    want = dict.fromkeys("ABCD", 0.25)
    out = {"A": "B", "B": "C", "C": "AD", "D": ""}
    for _ in range(100):
        want = {x: 0.15 / 4 + 0.85 * (sum(want[y] / len(out[y]) for y in out if x in out[y]) + want["D"] / 4) for x in want}
    assert sum(rank.values()) == pytest.approx(1) and all(rank[x] == pytest.approx(want[x], abs=1e-4) for x in want)
    between = {r.id: r.betweenness for r in graph.betweenness(v, g).collect()}
    assert between == {"A": pytest.approx(1 / 6), "B": pytest.approx(2 / 6), "C": pytest.approx(3 / 6), "D": 0.0}
    assert [r.nodes for r in graph.money_cycles(e).collect()] == [["A", "B", "C"]]
    calls = make(spark, [("S", f"P{k}", "CALLED", at(0, k), None) for k in range(5)] + [("T", f"P{k}", "CALLED", at(9 * k), None) for k in range(5)])
    assert [(r.node, r.call_degree) for r in graph.burner_clusters(calls).collect()] == [("S", 5)]


def test_risk(spark):
    people = spark.createDataFrame([("C", "A", 85.0), ("C", "B", 45.0), ("C", "Z", 10.0)], "case_id string, id string, base_risk_score double")
    e = make(spark, [("A", "B", "SUSPICIOUS_TRANSFER", at(0), 1.0)])
    got = {r.id: (r.likelihood, r.consequence, r.tier, r.threat_score, r.risk_level) for r in risk.threat_scores(people, e).collect()}
    assert got == {"A": (5, 5, "VERY HIGH", 100.0, "HIGH"), "B": (5, 4, "VERY HIGH", 90.0, "HIGH"), "Z": (1, 1, "VERY LOW", 20.0, "LOW")}


def test_ledger(spark):
    entries = spark.createDataFrame([(k, f"t{k}", "u", "a", "C") for k in range(1, 9)], "id long, timestamp string, actor_id string, action string, case_id string")
    chain = audit.build_chain(entries)
    assert audit.is_intact(chain).first().verified
    assert not audit.is_intact(chain.withColumn("action", F.when(F.col("id") == 3, "z").otherwise(F.col("action")))).first().verified
    assert not audit.is_intact(chain.where("id <> 4")).first().verified
    anchor = audit.head_of(chain.where("id <= 5"))
    assert audit.verify_anchor(chain, anchor).first() == ("APPENDED_SINCE_ANCHOR", 3)
    assert audit.verify_anchor(chain.where("id <= 3"), anchor).first().status == "TAMPER_OR_ROLLBACK"
    assert audit.verify_anchor(chain.where("id <= 5"), anchor).first().status == "MATCH" and audit.verify_anchor(chain, anchor.limit(0)).first().status == "NOT_ANCHORED"
    more = audit.append(chain, entries.withColumn("id", F.col("id") + 8))
    assert audit.is_intact(more).first() == (True, 16)


def test_state(spark):
    kind = "case_id string, id string, source_id string, target_id string, relation_type string, status string, reviewer string, reviewed_at string"
    old = spark.createDataFrame([("C", "A->B:X", "A", "B", "X", "PENDING", None, None)], kind)
    seen = state.review_links(old, spark.createDataFrame([("A->B:X", "approve", "me", "now")], "id string, verb string, reviewer string, reviewed_at string"))
    again = state.upsert_edges(seen, spark.createDataFrame([("C", None, "A", "B", "X", "PENDING", None, None)], kind))
    assert [(r.id, r.status, r.reviewer) for r in again.collect()] == [("A->B:X", "APPROVE", "me")] and state.pending_links(again).count() == 0
    assert state.insert_ignore(old, seen, ["id"]).first().status == "PENDING"


def test_evidence_and_tables(spark, tmp_path):
    assert len(state.bootstrap(spark, str(tmp_path))) == 10 and state.bootstrap(spark, str(tmp_path)) == []
    none = spark.read.parquet(f"{tmp_path}/evidence_sources")
    new = spark.createDataFrame([("e1", "CDR", "r", "{}"), ("e2", "CDR", "r", "{}")], "edge_id string, source_type string, reference string, details string")
    twice = state.append_evidence(state.append_evidence(none, new), new)
    assert twice.count() == 4 and twice.select("id").distinct().count() == 4
    assert sorted(r.edge_id for r in state.replace_evidence(twice, new.limit(1)).collect()) == ["e1", "e2", "e2"]
    bad = spark.createDataFrame([("x", 1.5)], "id string, confidence_score double")
    with pytest.raises(Exception, match="out of range"):
        state.checked(bad).collect()


def test_adapters(spark):
    assert adapters.source_types() == ["agency_report", "criminal_history", "social_media", "surveillance_report"]
    with pytest.raises(KeyError):
        adapters.get_adapter("x")
    rows = loaders.read_csv_text(spark, "record_id,name,aliases,phone,address,prior_case_ids\nR1,Ravi Das,RD|Rav,9876543210,Here,C1;C2\n,No Id,,,,")
    out = adapters.dispatch("criminal_history", rows, "C")
    again = {r.record_id for r in adapters.dispatch("criminal_history", rows.repartition(3), "C")["records"].collect()}
    assert {r.record_id for r in out["records"].collect()} == again
    assert loaders.read_csv_text(spark, 'a,b\n"x\ny",2\n').collect() == [("x\ny", "2")]
    assert {r.record_id[:3] for r in out["records"].collect()} == {"R1", "CH-"} and out["edges"].count() == 2 and out["nodes"].count() == 4
    posts = loaders.read_json_text(spark, '[{"account_handle":"@a","mentions":["B C","{\\"handle\\":\\"@d\\"}",""]}, 5]', "record_id string, account_handle string, author_name string, mentions array<string>")
    assert sorted(r.relation_type for r in adapters.dispatch("social_media", posts, "C")["edges"].collect()) == ["COMMUNICATES_WITH"] * 2
    text = spark.createDataFrame([("S1", "observed_at: 2023-01-02 03:04:05\nlocation: Old Fort\nRamesh Kumar was seen.")], "record_id string, text string")
    seen = adapters.dispatch("surveillance_report", text, "C")
    assert seen["text"]["nodes"].where("entity_type = 'PERSON'").count() >= 1 and seen["text"]["runs"].count() == 1
    assert adapters.dispatch("surveillance_report", text, "C", seen["text"]["runs"])["text"]["nodes"].count() == 0
    assert seen["observed"].count() == 1 and seen["properties"].first().value == "2023-01-02T03:04:05+00:00"


def test_loaders(spark, tmp_path):
    made = loaders.synthetic_case(spark)
    assert made["cdrs"].count() == 500 and made["transactions"].count() == 100
    txn = edges.enrich(loaders.txn_edges(made["transactions"], "C").withColumn("details", F.lit(None).cast("string")))
    assert txn.where("amount is null or ts is null").count() <= 100 and detect.circular_flow(txn).where("array_contains(entity_ids, 'ACCT-A')").count() == 1
    people = spark.createDataFrame([("P", ["9000000001"])], "id string, phone_numbers array<string>")
    assert loaders.cdr_edges(made["cdrs"], people, "C").where("source_id = 'P' or target_id = 'P'").count() > 10
    loaders.write(made["cdrs"], f"{tmp_path}/cdr.json")
    assert loaders.read_either(spark, str(tmp_path), "cdr").count() == 500
    nodes, e = loaders.fir_edges(spark.createDataFrame([("F1", "Ramesh Kumar met Suresh Sharma. Nobody came.")], "fir_no string, text string"), "C")
    assert nodes.count() == 2 and e.count() == 1


def test_seven_sources(spark, tmp_path):
    firs = [("F1", "Ramesh Kumar met Suresh Sharma near 9876543210. Nobody came.")]
    loaders.write(spark.createDataFrame(firs, "fir_no string, text string"), f"{tmp_path}/firs.json")
    calls = [("9876543210", "9000000009", "2023-05-01 10:00:00", 60), ("9000000009", "", "2023-05-01 11:00:00", 60)]
    loaders.write(spark.createDataFrame(calls, "caller string, callee string, timestamp string, duration_sec int"), f"{tmp_path}/cdrs.csv", "csv")
    txns = [("Ramesh Kumar", "X1", "500", "2023-05-02")]
    loaders.write(spark.createDataFrame(txns, "from_acct string, to_acct string, amount string, timestamp string"), f"{tmp_path}/transactions.csv", "csv")
    feeds = {
        "criminal_history": spark.createDataFrame([("R1", "Ramesh Kumar", "Ramu", "9876543210", "C7")], "record_id string, name string, aliases string, phone string, prior_case_ids string"),
        "surveillance_report": spark.createDataFrame([("S1", "2023-01-02 03:04:05", "Old Fort", "Ramesh Kumar was seen with Amit Verma.")], "record_id string, observed_at string, location string, text string"),
        "social_media": spark.createDataFrame([("@a", "Amit Verma", ["Suresh Sharma"])], "account_handle string, author_name string, mentions array<string>"),
        "agency_report": spark.createDataFrame([("G1", "Suresh Sharma called 9111111111 today.")], "record_id string, text string"),
    }
    done = loaders.load_sources(spark, str(tmp_path), "C", feeds)
    nodes = {r.name: r for r in done["entities"].collect()}
    assert {"Ramesh Kumar", "Suresh Sharma", "Amit Verma", "9000000009", "X1", "C7"} <= set(nodes)
    assert "+91-9876543210" in nodes["Ramesh Kumar"].phone_numbers and "Ramu" in nodes["Ramesh Kumar"].aliases
    kinds = {r.relation_type for r in done["edges"].collect()}
    assert {"CO_MENTIONED", "CALLED", "SUSPICIOUS_TRANSFER", "ASSOCIATED_WITH", "COMMUNICATES_WITH", "OBSERVED_AT"} <= kinds
    assert done["properties"].count() == 1 and done["stats"].where("kind = 'node'").count() >= 3


def test_streams(spark, tmp_path):
    from sleuthframe.streaming import jobs

    e = make(spark, [("H", f"P{k}", "CALLED", at(4 * k), None) for k in range(5)])
    e.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = jobs.store_findings(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/findings").count() == 1
    w = jobs.burner_windows(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), peers=1)
    q = w.writeStream.format("memory").queryName("burners").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from burners").count() > 0


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 25
    assert e.entry(spark).count() > 0


def test_spread_equals_exact_medians(spark):
    """Even and odd counts, ties, one value, negative values, two keys; an empty table."""
    from statistics import median

    groups = {"odd": [5, 1, 1, 9, -4], "even": [2, 2, 3, 10], "tied": [7] * 6, "one": [3], "halves": [0.5, 1.25, 1.25, 8.0]}
    rows = [(k, i % 2, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, part int, v double")
    for keys in (["k"], ["k", "part"]):
        want = {}
        for k, part, v in rows:
            want.setdefault((k, part)[: len(keys)], []).append(v)
        want = {k: (median(vs), median(abs(v - median(vs)) for v in vs), len(vs)) for k, vs in want.items()}
        got = {tuple(r[c] for c in keys): (r.own_median, r.own_mad, r.own_n) for r in detect._spread(df, keys, "v", "own").collect()}
        assert got == want
    assert detect._spread(df.limit(0), ["k"], "v", "own").collect() == []
