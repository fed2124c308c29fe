import json
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import evidence, graph, patterns, rules, similarity, upsert
from quern.plans import control, evaluation, planner
from quern.sources import envelopes, ontology
from quern.streaming import ingest


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def test_lab_rules(spark):
    facts = spark.createDataFrame([(1, "Potassium", "5.5"), (2, "Hba1C", "7"), (3, "Sodium", "abc"), (4, "TSH", "0.4"), (5, "Glucose", "179.9")], "id int, name string, value string")
    found = rules.threshold_signals(facts, ontology.lab_rules(spark), "name", "value")
    assert rows(found, "id", "condition") == [(1, "Hyperkalemia"), (2, "Diabetes Mellitus"), (4, "Hyperthyroidism")]
    assert rows(rules.threshold_signals(facts, ontology.lab_rules(spark), "name", "value", exact=True), "id") == [(1,), (4,)]


def test_claim_rules(spark):
    facts = spark.createDataFrame([(1, "professional", "99291"), (2, "institutional", None), (3, None, "00000"), (4, "institutional", "92950")], "id int, kind string, code string")
    found = rules.wildcard_signals(facts, ontology.claim_rules(spark), "kind", "code")
    assert rows(found, "id", "outcome") == [(1, "HO"), (1, "LT"), (2, "HO"), (4, "DE"), (4, "HO"), (4, "LT")]


def test_unknown_operator_is_an_error(spark):
    facts = spark.createDataFrame([("x", 1.0)], "name string, value double")
    bad = spark.createDataFrame([("r", "x", "about", 1.0, "c", "y", "low")], "rule_id string, observation string, operator string, bound double, condition string, reason string, severity string")
    with pytest.raises(Exception, match="unknown operator"):
        rules.threshold_signals(facts, bad, "name", "value").collect()


def test_repeated_rule_ids_are_an_error(spark):
    doubled = ontology.lab_rules(spark).unionByName(ontology.lab_rules(spark).limit(1))
    with pytest.raises(ValueError, match="rule_id"):
        ontology.checked_ids(doubled, "rule_id")
    assert ontology.checked_ids(ontology.lab_rules(spark), "rule_id").count() == 14


def test_fixed_tables(spark):
    counts = [f(spark).count() for f in (ontology.interactions, ontology.reactions, ontology.contraindications, ontology.outcomes, ontology.provenance, ontology.vocabulary)]
    assert counts == [40, 46, 23, 6, 6, 13]


def test_vocabulary_and_enrichment(spark):
    facts = spark.createDataFrame([(1, " hba1C "), (2, "unknown"), (3, None)], "id int, code string")
    found = rules.standardised(facts, ontology.vocabulary(spark), F.col("code"), "labs")
    assert rows(found.select("id", "standard.standard_system")) == [(1, "LOINC"), (2, None), (3, None)]
    people = spark.createDataFrame([("p1", None)], "patient_id string, name string")
    out = rules.enriched(spark.createDataFrame([("p1",), ("p2",), (None,)], "pid string"), {"patient": (people, "pid", "patient_id")})
    assert rows(out, "pid", "reference_hit_count") == [("p1", 1), ("p2", 0), (None, 0)]


def test_adverse_matches_respect_arrival(spark):
    notes = spark.createDataFrame([("n1", "p", "Confusion", 5), ("n2", "p", "confusion", 1), ("n3", "q", "confusion", 9)], "note_id string, patient_id string, symptom string, seq int")
    orders = spark.createDataFrame([("p", "Warfarin", 2), ("p", "Warfarin", 7)], "patient_id string, medication string, seq int")
    found = rules.adverse_matches(notes, orders, ontology.reactions(spark))
    assert rows(found, "note_id", "medication", "meddra_term") == [("n1", "Warfarin", "Confusion")]


def test_upserts(spark):
    log = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "q"), ("b", 5, "y", None), ("a", 3, "z", None)], "k string, seq int, u string, v string")
    assert rows(upsert.latest(log, ["k"], "seq", ["u", "v"])) == [("a", "z", None), ("b", "y", None)]
    assert rows(upsert.latest_known(log, ["k"], "seq", ["u", "v"])) == [("a", "z", "q"), ("b", "y", None)]
    assert rows(upsert.first_and_last(log, ["k"], "seq", "u"), "k", "first_seen", "last_seen") == [("a", "x", "z"), ("b", "y", None)]
    state = spark.createDataFrame([("a", 1), ("c", 1)], "k string, v int")
    assert rows(upsert.merged(state, spark.createDataFrame([("a", 2), ("d", 2)], "k string, v int"), ["k"])) == [("a", 2), ("c", 1), ("d", 2)]
    seen = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(upsert.first_wins(seen, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string"), "k")) == [("a",), ("b",), (None,), (None,)]
    assert rows(upsert.repeated_keys(seen.union(seen), "k"), "k") == [("a",), (None,)]


def test_paths_diamond_and_lists(spark):
    edges = spark.createDataFrame([(6, 1), (1, 2), (2, 3), (3, 4), (2, 2)], "src int, dst int")
    found = {tuple(r.path) for r in patterns.paths(edges, 3).where("src = 6").collect()}
    assert found == {(6, 1), (6, 1, 2), (6, 1, 2, 3), (6, 1, 2, 2)}
    orders = spark.createDataFrame([("p", "A", "new"), ("p", "A", "new"), ("p", "B", "new"), ("p", "B", "hold"), ("q", "A", "new"), ("p", "B", None)], "owner string, item string, state string")
    links = spark.createDataFrame([("A", "B", "high")], "item_a string, item_b string, severity string")
    assert patterns.diamond(orders, links).count() == 2
    owners = spark.createDataFrame([("p",), ("z",)], "owner string")
    assert rows(patterns.with_lists(owners, "owner", orders.select(F.col("owner").alias("o"), F.col("item").alias("items")), "o", {"items": 1})) == [("p", ["A"]), ("z", [])]
    values = patterns.together(orders.select("owner", "item"), orders.select("owner", "state"))
    assert rows(patterns.collected(values, "owner", {"item": 5, "state": 1})) == [("p", ["A", "B"], ["hold"]), ("q", ["A"], ["new"])]
    assert rows(patterns.listed_in_order(orders, "owner", F.col("item"), F.col("item"), 3)) == [("p", ["A", "A", "B"]), ("q", ["A"])]


def test_hot_owners_are_cut_before_they_are_collected(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("owner"), (F.col("id") % 5000).alias("v"))
    listed = patterns.listed(hot, "owner", F.col("v"), 20)
    assert listed.where("owner = 7").first().v == list(range(20)) or listed.where("owner = 7").first().v == sorted(r.v for r in hot.where("owner = 7").select("v").distinct().orderBy("v").limit(20).collect())
    assert "WindowGroupLimit" in listed._jdf.queryExecution().executedPlan().toString()


def test_history_in_two_levels(spark):
    log = spark.range(3000).select(F.when(F.col("id") % 10 < 8, 1).when(F.col("id") % 10 == 8, None).otherwise(F.col("id") % 7).alias("owner"), (F.col("id") * 7919 % 3001).alias("at"), (F.col("id") % 13).alias("size"), F.concat(F.lit("k"), F.col("id") % 5).alias("kind"))
    got = patterns.history(log, "owner", ["at"], previous="kind", size=F.col("size"))
    window = patterns.Window.partitionBy("owner").orderBy("at")
    want = log.select("*", F.row_number().over(window).alias("step"), F.lag("kind").over(window).alias("previous"), F.sum("size").over(window).alias("used"))
    assert got.columns == want.columns and rows(got) == rows(want)


def test_nearest(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "vec_id int, embedding array<double>, label int")
    best = similarity.nearest(points, points.where("vec_id = 5"), 2, keep=F.col("label") == 0)
    assert [r.vec_id for r in best.collect()] == [4, 2]


def test_evidence_ranks(spark):
    hits = spark.createDataFrame([("evt-b", "LAB_RESULT", 0.9), ("evt-c", "clinical_note", 0.99), ("evt-a", "lab_result", 0.9), ("evt-z", "vital_sign", 0.91), ("evt-n", None, None)], "event_id string, event_type string, score double")
    assert [r.event_id for r in evidence.ranked_hits(hits, "lab_interpretation").collect()] == ["evt-a", "evt-b", "evt-z", "evt-c", "evt-n"]
    assert [r.event_id for r in evidence.ranked_hits(hits, "lab_interpretation", exact=True).collect()][0] == "evt-a"
    cohort = spark.createDataFrame([("c", 1, 0), ("b", 1, 2), ("a", 2, 1)], "id string, c int, o int")
    assert [r.id for r in evidence.ranked_entities(cohort, "id", "c", "o").collect()] == ["a", "b", "c"]


def test_shaping(spark):
    made = spark.createDataFrame([("x" * 500, ["y" * 300] * 20, {"k": "z" * 300}, ("w" * 300, 1))], "a string, b array<string>, m map<string,string>, s struct<t:string,n:int>")
    r = evidence.shaped(made, "read_only").first()
    assert len(r.a) == 240 and len(r.b) == 5 and len(r.b[0]) == 240 and len(r.m["k"]) == 240 and len(r.s.t) == 240 and r.s.n == 1
    assert len(evidence.shaped(made, "export").first().b) == 10
    hits = spark.createDataFrame([("text",), (None,)], "text string")
    assert rows(evidence.redacted(hits, "generation")) == [(False,), (True,)]
    assert rows(evidence.redacted(hits, "export")) == [("text", False), (None, False)]


QUESTIONS = [
    ("Any adverse interaction?", "p1", 9, "medication_safety", 6),
    ("Explain the potassium", "p1", 0, "lab_interpretation", 1),
    ("Summary of available evidence", "p1", 9, "lab_interpretation", 6),
    ("Review the denial", "p1", 5, "coding_review", 5),
    ("Compare across patients", "p1", 2, "cohort_triage", 2),
    ("How is it going", None, 20, "cohort_triage", 8),
    ("How is it going", "p1", 20, "patient_summary", 5),
]


def test_planner_column_and_single_forms_agree(spark):
    asked = spark.createDataFrame([q[:3] for q in QUESTIONS], "q string, scope string, k int")
    kinds = asked.withColumn("kind", planner.classified(F.col("q"), F.col("scope")))
    plans = kinds.select("q", "kind", planner.planned(F.col("q"), F.col("kind"), F.col("scope"), F.col("k")).alias("p")).collect()
    for r, (q, scope, k, kind, top) in zip(plans, QUESTIONS):
        assert r.kind == kind and r.p.asDict() == planner.plan_one(q, scope, k) and r.p.top_k == top
    words = asked.select(planner.classified(F.col("q"), F.col("scope"), whole_words=True).alias("k")).collect()
    assert words[2].k == "patient_summary"
    assert planner.plan_one("Which supplier has geopolitical exposure?", None, 20, planner.SUPPLY)["name"] == "supplier_risk"


def test_control_loop():
    hit = lambda n: {"event_id": n, "owner": "p"}
    both = control.run_loop("q", "p", lambda plan: [hit(1)], lambda owners: [{"owner": o} for o in owners])
    assert both.stop == "confidence_reached" and len(both.trace) == 1
    count = iter(range(99))
    single = control.run_loop("q", None, lambda plan: [{"event_id": next(count)}], lambda owners: [])
    assert single.stop == "max_iterations_reached" and len(single.hits) == 3
    nothing = control.run_loop("q", None, lambda plan: [], lambda owners: [])
    assert nothing.stop == "no_progress_limit" and len(nothing.trace) == 2
    answers = iter(["LLM error: x", "fine"])
    assert control.retried(lambda: next(answers)) == "fine"
    assert "score 0.500" in control.prompt("q", [{"event_id": 1, "event_type": "t", "score": 0.5}], [])


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "a", ["x"], ["x", "y"], 10), ("a", "b", ["x", "z"], ["x"], 45), ("a", None, [], [], 99)], "e string, g string, w array<string>, f array<string>, s int")
    scored = cases.select(evaluation.routing_score(F.col("e"), F.col("g")).alias("routing"), evaluation.coverage_score(F.col("w"), F.col("f")).alias("coverage"), evaluation.linear_score(F.col("s"), 30, 60).alias("latency"))
    assert evaluation.means(scored, ["routing", "coverage", "latency"]).first() == (0.3333, 0.5, 0.5, 3)
    answers = ["", "LLM error: down", "short", "x" * 51 + " Consult a doctor", "y" * 5000, None]
    graded = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", evaluation.quality_score(F.col("a")).alias("q"), evaluation.caveat_score(F.col("a")).alias("c"), evaluation.completeness_score(F.col("i") > 1, F.col("i") > 3).alias("e"))
    assert [(r.q, r.c, r.e) for r in graded.orderBy("i").collect()] == [(0, 0, 0), (0, 0, 0), (0.5, 0, 0.5), (1, 1, 0.5), (0.5, 0, 1), (0, 0, 1)]
    assert evaluation.means(scored.limit(0), ["routing"]).first() == (0.0, 0)


def test_deserialised(spark):
    good = json.dumps({"event_id": "1", "event_type": "LAB_RESULT", "payload_json": '{"value": 5}'})
    raw = spark.createDataFrame([(good,), ("not json",), ('{"event_id": "2"}',), ('{"event_id": "3", "event_type": "X", "payload_json": "[1]"}',), ("{broken",), (None,), ('{"event_id": "4", "event_type": "X"}',)], "raw string")
    assert [r.problem for r in envelopes.deserialised(raw).collect()] == [None, "not a JSON object", "no id or type", "payload is not an object", "no id or type", "not a JSON object", None]


CLINICAL_EVENTS = [
    (1, "e1", "CLINICAL_NOTE", "p1", '{"diagnosis": "Hyperkalemia", "symptom": "cough", "icd10_code": "E87.5"}'),
    (2, "e2", "CLINICAL_NOTE", "p1", '{"diagnosis": "Hyperkalemia", "symptom": null, "event_family": "ALLERGY_INTOLERANCE", "allergen": "Penicillin"}'),
    (3, "e3", "CLAIM_STATUS", "p2", '{"claim_id": "c1", "payer": "P", "status": "submitted", "procedure_code": "99291", "procedure_description": "first"}'),
    (4, "e4", "CLAIM_STATUS", "p2", '{"claim_id": "c1", "payer": "P", "status": "denied", "procedure_code": "99291", "procedure_description": "second"}'),
    (5, "e5", "VITAL_SIGN", "p2", '{"device_id": "d1", "device_type": "monitor", "heart_rate": 70}'),
    (6, "e6", "VITAL_SIGN", "p2", '{"device_id": "d1", "heart_rate": 71}'),
    (7, "e7", "MEDICATION_ORDER", None, '{"medication": "Warfarin"}'),
]


def clinical(spark):
    made = [(s, i, f"2024-01-0{s}T00:00:00Z", "EHRSystem", "EHR", k, p, f"enc-{p}", None, "1.0.0", j) for s, i, k, p, j in CLINICAL_EVENTS]
    return spark.createDataFrame(made, "arrival_seq long, event_id string, event_ts string, source_system string, source_type string, event_type string, patient_id string, encounter_id string, provider_id string, schema_version string, payload_json string")


def shown(rows, *key):
    """The properties of nodes or edges as a dictionary of texts."""
    table = rows.withColumn("props", graph.shown())
    return {tuple(r[k] for k in key): dict(p.split("=", 1) for p in r.props.split(";") if p) for r in table.collect()}


def test_graph_from_events(spark):
    events = envelopes.with_payload(clinical(spark), envelopes.clinical_payload())
    nodes, edges = graph.build(events, graph.program_of(graph.CLINICAL_BASE, graph.CLINICAL))
    found = shown(nodes, "label", "key")
    condition = found["Condition", "Hyperkalemia"]
    assert condition["first_seen_ts"].startswith("2024-01-01") and condition["last_seen_ts"].startswith("2024-01-02")
    assert found["Claim", "c1"]["status"] == "denied" and found["Procedure", "99291"]["description"] == "first"
    assert found["Device", "d1"] == {"device_type": "monitor"}
    assert found["AdverseEvent", "ae-allergy-e2"]["allergen"] == "Penicillin" and ("AdverseEvent", "ae-allergy-e1") not in found
    assert ("Symptom", "cough") in found and not any(k is None for _, k in found)
    kinds = shown(edges, "kind", "src", "dst")
    assert kinds["HAS_CONDITION", "p1", "Hyperkalemia"]["onset_ts"].startswith("2024-01-01")
    assert ("ORDERS_MEDICATION", "e7", "Warfarin") in kinds and ("ABOUT_PATIENT", "e7", None) not in kinds
    assert upsert.repeated_keys(nodes.select(F.concat_ws(":", "label", "key").alias("k")), "k").count() == 0


def test_a_provider_sees_an_encounter(spark):
    events = clinical(spark).limit(1).withColumn("provider_id", F.lit("pr1"))
    _, edges = graph.build(events.unionByName(events.withColumns({"encounter_id": F.lit(None).cast("string"), "provider_id": F.lit("pr2")})), graph.CLINICAL_BASE)
    seen = edges.where("kind = 'SEEN_BY'").collect()
    assert [(r.src_label, r.src, r.dst) for r in seen] == [("Encounter", "enc-p1", "pr1")]


def test_properties_keep_their_type(spark):
    events = envelopes.with_payload(clinical(spark).where("event_id = 'e5'"), envelopes.clinical_payload())
    nodes, _ = graph.build(events, graph.program_of((), graph.CLINICAL))
    rate = nodes.where("label = 'DeviceReading'").selectExpr("schema_of_variant(props['heart_rate']) as kind", "variant_get(props['heart_rate'], '$', 'int') > 9 as fast").first()
    assert rate.kind == "BIGINT" and rate.fast


def test_who_makes_a_node_decides_what_is_set_on_creation(spark):
    program = (graph.Node("C", "k", once={"first": "seq"}, again={"last": "seq"}), graph.Edge("E", ("D", "d"), ("C", "other"), matched=True))
    rows = spark.createDataFrame([(1, "a", None, None), (2, "a", "d1", "b"), (3, "b", None, None), (4, "b", "d1", "b"), (3, "x", "d2", "nowhere"), (2, None, "d3", "b")], "seq int, k string, d string, other string")
    nodes, edges = graph.build(rows, program, "seq")
    found = shown(nodes, "label", "key")
    assert found["C", "a"] == {"first": "1", "last": "2"} and found["C", "b"] == {"first": "3", "last": "4"} and ("C", "nowhere") not in found
    assert set(shown(edges, "src", "dst")) == {("d1", "b")}  # the write of d3 came before the node


def test_one_scan_for_a_whole_program(spark, sf_dir):
    from quern.plans import catalog

    plan = catalog.QUERIES["base_graph_nodes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= 2


def test_supply_graph(spark):
    made = [
        (1, "s1", "DISRUPTION_ALERT", '{"disruption_id": "x1", "facility_id": "f1", "affected_parts": ["a", "b", null], "severity": "high", "region": "north"}'),
        (2, "s2", "INVENTORY_LEVEL", '{"facility_id": "f1", "part_id": "a", "on_hand_qty": 5, "below_reorder": true}'),
        (3, "s3", "INVENTORY_LEVEL", '{"facility_id": "f1", "part_id": "a", "on_hand_qty": 9}'),
    ]
    events = spark.createDataFrame([(s, i, "2024-01-01", "ERP", "ERP", k, None, "f1", None, "1", j) for s, i, k, j in made], "arrival_seq long, event_id string, event_ts string, source_system string, source_type string, event_type string, entity_id string, facility_id string, supplier_id string, schema_version string, payload_json string")
    nodes, edges = graph.build(envelopes.with_payload(events, envelopes.supply_payload()), graph.program_of(graph.SUPPLY_BASE, graph.SUPPLY))
    found = shown(edges, "kind", "src", "dst")
    assert {d for k, s, d in found if k == "AFFECTS_PART"} == {"a", "b"}
    assert found["HOLDS_INVENTORY", "f1", "a"]["on_hand_qty"] == "9" and "below_reorder" not in found["HOLDS_INVENTORY", "f1", "a"]
    assert shown(nodes, "label", "key")["Facility", "f1"] == {"region": "north"}


def test_payload_fields_of_two_types_are_an_error():
    assert envelopes.payload_schema("a int, b string", "b string, c long") == "a int, b string, c long"
    with pytest.raises(ValueError, match="b is string and long"):
        envelopes.payload_schema("b string", "b long")


def test_synthetic_events_are_skewed_and_repeatable(spark):
    made = envelopes.synthetic_events(spark, 5000)
    hot = made.where(F.regexp_extract("patient_id", r"p-(\d+)", 1).cast("int") < 120).count()
    assert 0.65 < hot / 5000 < 0.75
    assert sorted(map(str, made.collect())) == sorted(map(str, envelopes.synthetic_events(spark, 5000, partitions=7).collect()))


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    sink = ingest.WriteLog(spark, str(tmp_path / "t"), ["k"], "seq", ["v"])
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    b = spark.createDataFrame([("a", 2, "z"), ("a", 1, "q")], "k string, seq int, v string")
    sink.apply(a, 0)
    sink.apply(b, 1)
    sink.apply(b, 1)
    assert rows(sink.read(), "k", "v") == [("a", "z"), ("b", "y")]
    late = spark.createDataFrame([("a", 1, "old")], "k string, seq int, v string")
    sink.apply(late, 2)
    assert rows(sink.read(), "k", "v") == [("a", "z"), ("b", "y")]
    short = sink.compacted(str(tmp_path / "u"), 2)
    assert rows(short.read(), "k", "v") == [("a", "z"), ("b", "y")]
    short.apply(spark.createDataFrame([("b", 9, "w")], "k string, seq int, v string"), 3)
    assert rows(short.read(), "k", "v") == [("a", "z"), ("b", "w")]


def test_collections_check_their_shape(spark, tmp_path):
    from quern.operators import normalise

    points = ingest.Collection(spark, str(tmp_path / "c"))
    events = envelopes.with_payload(clinical(spark), envelopes.clinical_payload()).withColumn("text", F.lit("some words"))
    points.apply(normalise.vector_record(events), 0)
    points.apply(normalise.vector_record(events), 1)
    assert ingest.Collection(spark, str(tmp_path / "c")).read().count() == 7
    with pytest.raises(ValueError, match="cosine"):
        ingest.Collection(spark, str(tmp_path / "c"), dimension=10)
    with pytest.raises(Exception, match="384 components"):
        points.apply(normalise.vector_record(events).withColumn("embedding", F.array(F.lit(1.0))), 2)


def test_references_come_first(spark):
    seen = []
    batch = spark.createDataFrame([("event", 1), ("reference", 2)], "route string, id int")
    ingest.references_first(batch, lambda d: seen.append(("r", d.count())), lambda d: seen.append(("e", d.count())))
    assert seen == [("r", 1), ("e", 1)]
    routed = batch.select(envelopes.route(F.col("route"), ["reference"], ["event"]).alias("r"))
    assert {r.r for r in routed.collect()} == {"reference", "event"}


def test_rendered_sentences(spark):
    from quern.operators import normalise

    events = [
        ("LAB_RESULT", "p1", "LIS", '{"lab_name": "Potassium", "value": 5.50, "unit": "mmol/L", "abnormal": true}'),
        ("INVENTORY_LEVEL", None, None, '{"facility_id": "f", "part_id": "a", "on_hand_qty": 3, "below_reorder": true, "days_of_supply": 1.0}'),
        ("PURCHASE_ORDER", None, None, '{"po_number": "1", "part_id": "a"}'),
        ("OTHER", None, None, '{"x": 1}'),
    ]
    made = spark.createDataFrame(events, "event_type string, patient_id string, source_system string, payload_json string")
    both = normalise.CLINICAL_SENTENCES | normalise.SUPPLY_SENTENCES
    text = [r.t for r in made.select(normalise.rendered(F.col("event_type"), F.col("payload_json"), both, F.col("payload_json"), 5).alias("t")).collect()]
    assert text[0] == "Patient p1 lab result. Potassium equals 5.50 mmol/L. Panel None. Specimen None. Abnormal: True" or text[0].startswith("Patient p1 lab result. Potassium equals 5.5")
    assert text[1] == "Inventory at f part a on_hand 3 BELOW REORDER days_of_supply 1.0."
    assert text[2] == "Purchase order 1 from supplier None for part a qty None status None."
    assert text[3] == '{"x":'


def test_normalised_events_and_vector_records(spark):
    from quern.operators import normalise

    typed = envelopes.payload_of(clinical(spark), "CLINICAL_NOTE").withColumn("payload", F.col("payload").withField("symptom", F.lit("  Chest   PAIN ")).withField("icd10_code", F.lit("e87.5")))
    r = normalise.normalised(typed, "CLINICAL_NOTE").first()
    assert (r.payload.symptom, r.payload.icd10_code, r.source_type) == ("chest pain", "E87.5", "EHR")
    people = spark.createDataFrame([((" f ", "HIGH", "41"),), (None,)], "patient struct<sex:string,risk_tier:string,age:string>")
    out = normalise.normalised_reference(people, ["patient"]).withColumn("said", normalise.reference_summary(["patient"])).collect()
    assert out[0].patient.sex == "F" and out[0].said == "Patient profile age 41, sex F, risk high." and out[1].said == ""
    flat = envelopes.with_payload(clinical(spark), envelopes.clinical_payload()).selectExpr("*", "1 as reference_hit_count", "'high' as trust_level", "'x' as phi_class", "'some text' as text")
    point = normalise.vector_record(flat).where("payload.event_id = 'e2'").first()
    assert point.payload.enriched and len(point.embedding) == 384 and point.point_id > 0
    assert point.payload.event_family == "ALLERGY_INTOLERANCE" and point.payload.retention_class is None and point.payload.patient_id == "p1" and point.payload.payload.allergen == "Penicillin"
    assert not normalise.vector_record(flat.drop("reference_hit_count")).first().payload.enriched
    mapping = spark.range(1).select(normalise.code_mapping("CPT", F.lit("99291"), F.lit("care")).alias("a"), normalise.code_mapping("CPT", F.lit(None).cast("string"), F.lit("care")).alias("b")).first()
    assert mapping.a.standard_code == "99291" and mapping.b is None


def test_specialists(spark):
    from quern.operators import specialists

    context = spark.createDataFrame(
        [
            ("p1", [("A", "B")], [], [("A", "c")], [("s",)], [("K", True), ("Na", None)], [("c1",)], [("x", "Hyperkalemia")], [("Hyperkalemia",), ("CKD",)]),
            ("p2", [], [], [], [], [("Na", False)], [], [], []),
        ],
        "patient_id string, interactions array<struct<a:string,b:string>>, adverse_events array<struct<a:string>>, contraindications array<struct<a:string,b:string>>, lab_signals array<struct<a:string>>, observations array<struct<name:string,abnormal:boolean>>, claims array<struct<id:string>>, icd10_codes array<struct<code:string,condition:string>>, conditions array<struct<name:string>>",
    )
    assert rows(specialists.medication_safety(context), "patient_id", "interaction_count", "contraindication_count") == [("p1", 1, 1)]
    assert rows(specialists.lab_interpretation(context), "patient_id", "abnormal_observation_count") == [("p1", 1)]
    assert rows(specialists.coding_review(context), "patient_id", "uncoded_conditions") == [("p1", ["CKD"])]
    suppliers = spark.createDataFrame([("s1", [("quality",), ("other",)], ["a"]), ("s2", [], [])], "supplier_id string, risk_signals array<struct<signal:string>>, parts array<string>")
    assert [rows(f(suppliers), "supplier_id") for f in (specialists.supplier_risk, specialists.disruption_impact, specialists.quality_review)] == [[("s1",)]] * 3
    facts = spark.createDataFrame([(20, 10, 0.01), (5, 10, 0.2), (1, 1, None)], "actual_lead_days int, expected_lead_days int, defect_rate double")
    assert [[s.rule_id for s in r.signals] for r in specialists.supply_signals(facts).collect()] == [["lead_time_exceeded"], ["quality_rejection_rate"], []]


def test_tools(spark, tmp_path):
    from quern.plans import tools

    desk = tools.Tools(spark, str(tmp_path / "audit"))
    desk.register("query", lambda q: {"answer": q})
    assert desk.call("generation", "query", q="x") == {"answer": "x"}
    with pytest.raises(tools.NotAuthorised, match="not authorized"):
        desk.call("read_only", "query", q="x")
    assert desk.flush() == 2 and desk.flush() == 0
    assert sorted(r.outcome for r in spark.read.json(str(tmp_path / "audit")).collect()) == ["denied", "success"]
    big = {"answer": "a" * 200, "vector_context": [{"t": "x" * 100}] * 3, "graph_context": [{"t": "y" * 100}] * 3}
    fitted = tools.fit_response(big, 450)
    assert len(tools.canonical(fitted)) <= 450 and not fitted["vector_context"]
    with pytest.raises(RuntimeError):
        tools.fit_response(big, 10)
    layer = {"business_goals": {"g": {"skills": ["a", "b"]}}, "skills": {"a": {"mcp_tools": ["t", "u"]}, "b": {"mcp_tools": ["u", "v"]}}}
    assert tools.skill_plan(layer, "g")["mcp_tools"] == ["t", "u", "v"]
    with pytest.raises(ValueError, match="unknown goal"):
        tools.skill_plan(layer, "h")


def test_requests_and_responses(spark):
    from quern.plans import tools

    assert tools.validated("query", {"question": "why?", "patient_id": None})
    for name, arguments in (("query", {"question": "x"}), ("query", {}), ("query", {"question": "why?", "extra": 1}), ("vector_evidence_search", {"question": "why?", "top_k": 6}), ("graph_answer_generate", {"question": "why?", "response_style": "rude"})):
        with pytest.raises(ValueError):
            tools.validated(name, arguments)
    made = tools.built_response({"question": "q", "answer": "a", "secret": 1}, "export", "bounded")
    assert "secret" not in made and made["guardrails"]["graph_access_level"] == "broader" and not made["guardrails"]["evidence_text_redacted"]
    assert tools.setting(" a, b,, ") == ["a", "b"] and tools.setting("True", "flag") and not tools.setting(None, "flag")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert tools.graph_sql(spark, {"links": edges}, "select count(*) as n from links").first().n == 1


def test_seeds_allergies_and_corrections(spark):
    edges, nodes = ontology.seed_edges(spark), ontology.seed_nodes(spark)
    assert edges.count() == 109 and upsert.repeated_keys(nodes.select(F.concat_ws(":", "label", "key").alias("k")), "k").count() == 0
    notes = spark.createDataFrame([(1, "Penicillin"), (2, "Peanuts"), (3, "Morphine")], "note_id int, allergen string")
    drugs = spark.createDataFrame([("Penicillin",), ("Peanuts",)], "medication string")
    assert rows(rules.allergy_matches(notes, drugs)) == [(1, "Penicillin")]
    log = spark.createDataFrame([("a", False, None), ("b", True, "a"), ("c", True, None)], "event_id string, is_correction boolean, correction_of_event_id string")
    assert rows(ingest.corrected(log, apply=True), "event_id") == [("b",), ("c",)] and ingest.corrected(log).count() == 3
    ingest.console(ingest.replayed(spark, "/root/testdata/sf0.001/region.parquet")).awaitTermination()


def test_small_pattern_helpers(spark):
    lists = spark.createDataFrame([(["b", None, "a"], ["a", "c"])], "x array<string>, y array<string>")
    assert lists.select(patterns.involved(F.col("x"), F.col("y")).alias("v")).first().v == ["a", "b", "c"]
    table = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert rows(patterns.restricted(table, "k", [2])) == [(2, "y")] == rows(patterns.restricted(table, "k", table.where("k = 2")))
    assert patterns.without(table, "v").columns == ["k"]


def test_more_text(spark):
    from quern.functions import text as T

    r = spark.range(1).select(T.moment(F.lit("2024-01-02T03:04:05+00:00")).alias("m"), T.moment(F.lit("never")).alias("n"), T.json_cut(F.struct(F.lit("x" * 50).alias("a")), 10).alias("j"), T.share(F.lit(1), F.lit(0)).alias("s"))
    first = r.select(T.iso(F.col("m")).alias("i"), "n", "j", "s").first()
    assert (first.i, first.n, first.j, first.s) == ("2024-01-02T03:04:05", None, '{"a":"xxxx', 0.0)


def test_embedding_counts_every_token_once(spark):
    import hashlib
    import math

    from quern.functions import vectors

    texts = ["Fox fox dog", "", None, " ".join(f"word{i % 700}" for i in range(3000))]
    for text, found in zip(texts, [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(vectors.embedding(F.col("t")).alias("v")).collect()]):
        counts = [0] * 384
        for token in (text or "").lower().split():
            counts[int(hashlib.md5(token.encode()).hexdigest(), 16) % 384] += 1
        length = math.sqrt(sum(c * c for c in counts))
        assert found == pytest.approx([c / length if length else 0.0 for c in counts])


def test_large_packs_are_not_broadcast(spark, monkeypatch):
    pack = ontology.lab_rules(spark)
    assert "broadcast" in rules.packed(pack)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(rules, "MAX_RULES", 3)
    assert rules.packed(pack) is pack


def test_a_shared_folder_is_asked_for_off_local_masters(spark, monkeypatch):
    from quern.sources import shared

    class Context:
        master = "spark://somewhere"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_appended_rounds_keep_repeats(spark):
    one = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(upsert.appended(one, one.limit(1))) == [("a", 1), ("a", 2), ("b", 1)]


def test_rule_pack_directories(spark, tmp_path):
    good = {"version": "1", "status": "draft", "owner": "o", "purpose": "p", "rules": [{"id": "a", "value": 1}, {"id": "b"}]}
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "labs.json").write_text(json.dumps(good))
    (tmp_path / "rules" / "none.json").write_text(json.dumps(good | {"rules": []}))
    packs = ontology.rule_packs(spark, str(tmp_path))
    assert set(packs) == {"labs", "none"} and rows(packs["labs"], "id") == [("a",), ("b",)] and packs["none"].count() == 0
    for bad in ("[1]", "{", json.dumps(good | {"owner": ""}), json.dumps(good | {"status": "odd"}), json.dumps(good | {"rules": [{"id": "a"}, {"id": "a"}]}), json.dumps(good | {"rules": [{"x": 1}]})):
        (tmp_path / "rules" / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            ontology.rule_packs(spark, str(tmp_path))


def test_seed_nodes(spark):
    found = shown(ontology.seed_nodes(spark), "label", "key")
    count = lambda label: sum(k[0] == label for k in found)
    assert count("Condition") == 20 and count("Symptom") == 15 and count("AdverseOutcome") == 6
    assert found["Medication", "Insulin Glargine"] == {"activeIngredient": "Insulin glargine", "isValidatedTradeNameUsed": "true"}
    assert found["AdverseOutcome", "DE"] == {"description": "Death"}


def test_the_ten_tools(spark):
    from quern.functions import vectors
    from quern.plans import desk, tools

    context = spark.createDataFrame(
        [("p1", [("Hyperkalemia",)], [("Potassium", 6.1, "mmol/L", True)], [("Warfarin", "Aspirin", "bleeding_risk", "high")], [], [("Digoxin", "Hyperkalemia", "r")], [], [("c1", "denied")], [("E87", "Anemia")])],
        "patient_id string, conditions array<struct<name:string>>, observations array<struct<name:string,value:double,unit:string,abnormal:boolean>>, interactions array<struct<from:string,to:string,risk:string,severity:string>>, adverse_events array<struct<symptom:string>>, contraindications array<struct<medication:string,condition:string,reason:string>>, lab_signals array<struct<observation:string>>, claims array<struct<claim:string,status:string>>, icd10_codes array<struct<code:string,condition:string>>",
    )
    texts = [("e1", "p1", "MEDICATION_ORDER", "warfarin and aspirin ordered"), ("e2", "p1", "LAB_RESULT", "potassium high"), ("e3", "p2", "LAB_RESULT", "sodium low")]
    points = spark.createDataFrame(texts, "event_id string, patient_id string, event_type string, text string").withColumn("embedding", vectors.embedding(F.col("text")))
    timeline = points.select("patient_id", "event_id", "event_type", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(substr(event_id, 2) as int) * 30)").alias("event_ts"))
    heard = []
    answer = lambda prompt: heard.append(prompt) or "Consult a doctor."
    skills = {"business_goals": {"g": {"skills": ["s"]}}, "skills": {"s": {"mcp_tools": ["t"]}}}
    office = desk.register(tools.Tools(spark), context, points, timeline, answer, skills)
    assert set(office.tools) == {t for names in tools.POLICY.values() for t in names}
    assert set(office.call("read_only", "patient_context_get", patient_id="p1", include_claims=False)["patient"]) == set(context.columns) - {"claims"}
    assert office.call("read_only", "patient_context_get", patient_id="nobody")["patient"] is None
    hits = office.call("read_only", "vector_evidence_search", question="potassium high", top_k=2)["hits"]
    assert hits[0]["event_id"] == "e2" and hits[0]["text_redacted"] and "text" not in hits[0]
    made = office.call("generation", "query", question="Is there a warfarin interaction?", patient_id="p1")
    assert made["request_type"] == "medication_safety" and [h["event_id"] for h in made["vector_context"]][0] == "e1" and made["trace"][-1]["findings"] == 1
    assert "drug_interactions=Warfarin+Aspirin (bleeding_risk/high)" in heard[0] and "symptoms=none" in heard[0] and "observations=Potassium=6.1mmol/L" in heard[0]
    assert office.call("generation", "medication_risk_assess", patient_id="p1")["findings"][0]["interaction_count"] == 1
    assert office.call("generation", "coding_gap_detect", patient_id="p1")["findings"][0]["uncoded_conditions"] == ["Hyperkalemia"]
    assert [e["event_id"] for e in office.call("generation", "timeline_explain", patient_id="p1", time_window_hours=10)["timeline"]] == ["e2"]
    assert office.call("generation", "risk_summary_generate", patient_id="p1", time_window_hours=100)["events"] == [{"event_type": "LAB_RESULT", "n": 1}, {"event_type": "MEDICATION_ORDER", "n": 1}]
    assert office.call("generation", "cohort_risk_summary")["cohort"][0]["patient_id"] == "p1"
    assert office.call("export", "evidence_bundle_export", question="Any potassium?")["guardrails"]["graph_access_level"] == "broader"
    assert office.call("generation", "graph_answer_generate", question="Any potassium?")["response_style"] == "concise"
    assert office.call("read_only", "skills_plan_get", goal="g")["mcp_tools"] == ["t"]
    assert len(office.log) >= 11


def test_waits_double(spark):
    waits, answers = [], iter(["LLM error: a", "LLM error: b", "fine"])
    assert control.retried(lambda: next(answers), wait=1.5, sleep=waits.append) == "fine" and waits == [1.5, 3.0]
    assert "supplier=s1" in control.supplier_prompt("q", [], [{"supplier_id": "s1", "parts": ["a"]}])


def test_rendered_sentences_read_an_object_once(spark):
    from quern.operators import normalise

    odd = ['{"quantity": 1.50, "po_number": "1.50"}', '{"quantity": 1e5}', '{"quantity": {"a": 1, "b": [1, 2]}}', '{"quantity": "cut', None, "", "[{}]", "null", "{}", '{"quantity": true, "status": "true"}', '{"quantity": 1, "quantity": 2}', '{"part_name": null, "part_id": 7}', '{"quantity": -0, "status": " 1"}', '{"quantity": 12345678901234567890123, "status": NaN}', "{'quantity': 'q'}", '{"quantity": 1} more', '{"status": "\\ud83d"}', '{"x": {"quantity": 9}}']
    rows = spark.createDataFrame([(j,) for j in odd], "j string")
    pattern = normalise.SUPPLY_SENTENCES["PURCHASE_ORDER"]
    made = rows.select(normalise.sentence(pattern, F.col("j")).alias("a"), normalise.rendered(F.lit("PURCHASE_ORDER"), F.col("j"), normalise.SUPPLY_SENTENCES, F.col("j")).alias("b"))
    assert all(r.a == r.b for r in made.collect())
    # Fields of an object are looked up; only those that may read differently are read again.
    plan = made.select("b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_a_context_parses_its_events_once(spark, sf_dir):
    from quern.plans import domain

    known = domain.read_once(spark, sf_dir)
    for name in domain._CONTEXT:
        plan = domain._context_rows(spark, sf_dir, name, known)._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "parquet" not in plan, name


def test_lists_of_many_values_take_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(patterns, "ROWS_A_TASK", 100)
    found = spark.range(2000).selectExpr("id % 7 as owner", "case when id % 2 = 0 then id % 50 end as a", "case when id % 2 = 1 then named_struct('x', 'y', 'v', id % 90) end as b")
    found = found.unionByName(found.limit(100)).unionByName(spark.createDataFrame([(None, 1, None), (3, None, None)], found.schema))
    of = lambda **known: patterns.collected(found, "owner", {"a": 3, "b": 20}, **known)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(of(expected=2000)) == shown(of())
    assert "21" in re.findall(r"RepartitionByExpression .*, (\d+)", of(expected=2000)._jdf.queryExecution().optimizedPlan().toString())
