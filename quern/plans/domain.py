"""Queries over clinical and supply-chain events: write programs, rule packs, seeds and renderings.

The events of the standard tables stand in for clinical ones, lineitems for supply-chain ones.  What an
event says is written once, as SQL that Spark and DuckDB both read (``CLINICAL``, ``SUPPLY``); what the
graph, the rules and the lookups make of it is computed by the operators here and by plain SQL there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph, normalise, patterns, rules
from quern.plans.registry import query, table
from quern.sources import envelopes, ontology, packs
from quern.sources.shared import materialize, new_folder
from quern.streaming import ingest

# -- Events -------------------------------------------------------------------------------------------


def _cases(of: str, values: tuple) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def _text(number: str, prefix: str = "") -> str:
    return f"concat('{prefix}', CAST({number} AS STRING))"


_MEDICATIONS = ("Warfarin", "Aspirin", "Azithromycin", "Lisinopril", "Spironolactone", "Digoxin", "Furosemide", "Ibuprofen", "Metformin", "Morphine")
_CONDITIONS = ("Hyperkalemia", "Anemia", "Chronic Kidney Disease", "Heart Failure", None)
_LABS = ("Potassium", "Glucose", "Sodium", "TSH", "INR", "hba1c", "Calcium")
_MAPPED = "k % 5 < 3"


def _mapping(name: str, system: str) -> dict[str, str]:
    return {f"{name}_system": f"CASE WHEN {_MAPPED} THEN '{system}' END", f"{name}_code": f"CASE WHEN {_MAPPED} THEN {_text('k % 5', 'code-')} END", f"{name}_display": f"CASE WHEN {_MAPPED} AND k % 2 = 0 THEN {_text('k % 5', 'Term ')} END"}


#: Envelope of every clinical event; ``k`` is a number in the event's properties.
ENVELOPE = {
    "seq": "event_id",
    "id": _text("event_id", "ev-"),
    "stamp": "CAST(date_trunc('second', ts) AS STRING)",
    "source_type": "upper(event_type)",
    "type": "CASE event_type WHEN 'signup' THEN 'CLINICAL_NOTE' WHEN 'purchase' THEN 'MEDICATION_ORDER' WHEN 'view' THEN 'LAB_RESULT' WHEN 'click' THEN 'CLAIM_STATUS' ELSE 'VITAL_SIGN' END",
    "patient_id": _text("user_id", "p-"),
    "encounter_id": f"CASE WHEN value > 50 THEN {_text('event_id % 97', 'enc-')} END",
    "provider_id": f"CASE WHEN event_id % 3 = 0 THEN {_text('event_id % 7', 'prov-')} END",
    "words": _text("event_id", "event "),
}
#: Payload fields by event type.
CLINICAL = {
    "CLINICAL_NOTE": {
        "diagnosis": _cases("k % 5", _CONDITIONS),
        "symptom": _cases("k % 4", ("cough", "confusion", "dizziness", None)),
        "icd10_code": f"CASE WHEN value > 30 THEN {_text('k % 13', 'E')} END",
        "event_family": "CASE WHEN k % 3 = 0 THEN 'ALLERGY_INTOLERANCE' ELSE 'PROBLEM' END",
        "allergen": _cases("k % 9", ("Aspirin", None, None, "Peanuts", None, None, "Morphine")),
        "reaction_severity": "CASE WHEN k % 2 = 0 THEN 'severe' END",
    },
    "LAB_RESULT": {"lab_name": _cases("k % 7", _LABS), "value": "CAST(floor(value) AS STRING)", "unit": "CASE WHEN k % 2 = 0 THEN 'mmol/L' END", "abnormal": "CASE WHEN value > 40 THEN value > 100 END", "specimen_type": "'blood'"},
    "VITAL_SIGN": {"device_id": _text("k % 9", "dev-"), "device_type": "CASE WHEN value > 60 THEN 'monitor' END", "heart_rate": "60 + k", "systolic_bp": "CASE WHEN k % 4 > 0 THEN 100 + k END", "diastolic_bp": "60 + k % 30", "alert": "CASE WHEN value > 150 THEN 'HIGH' END"},
    "MEDICATION_ORDER": {"medication": _cases("k % 10", _MEDICATIONS), "drug_class": "CASE WHEN value > 50 THEN concat('class-', CAST(k % 10 AS STRING)) END", "dose": "'5 mg'", "route": "CASE WHEN k % 2 = 0 THEN 'oral' ELSE 'iv' END", "order_type": "CASE event_id % 6 WHEN 0 THEN 'discontinued' WHEN 1 THEN 'hold' ELSE 'new' END", "days_supply": "k % 30"},
    "CLAIM_STATUS": {
        "claim_id": _text("event_id % 211", "clm-"),
        "payer": f"CASE WHEN k % 8 > 0 THEN {_text('k % 8', 'payer ')} END",
        "procedure_code": _cases("k % 6", ("99291", "92950", "27447", "31500", "99213", None)),
        "procedure_description": _text("event_id", "as of "),
        "diagnosis_code": "CASE WHEN k % 7 > 0 THEN 'I10' END",
        "status": "CASE WHEN value > 120 THEN 'denied' WHEN value > 40 THEN 'paid' END",
        "claim_type": "CASE WHEN k % 3 = 0 THEN 'institutional' ELSE 'professional' END",
        "billed_amount": "CAST(floor(value) AS DOUBLE) + 0.5",
    },
}
#: Mappings to standard terminologies: (path in ``semantic``, name, system).
MAPPINGS = (("condition.mapping", "condition", "SNOMED_CT"), ("symptom.mapping", "symptom", "MedDRA"), ("observation.mapping", "observation", "LOINC"), ("medication.mapping", "drug", "RxNorm"), ("claim.diagnosis_mapping", "diagnosed", "ICD10"), ("claim.procedure_mapping", "done", "CPT"))
#: Reference data of some events: (kind, field, value).
REFERENCES = (
    ("patient", "name", _text("user_id", "Name ")), ("patient", "sex", "CASE WHEN user_id % 2 = 0 THEN 'F' END"), ("patient", "age", "20 + k"), ("patient", "risk_tier", "CASE WHEN k % 2 = 0 THEN 'high' END"),
    ("provider", "specialty", "CASE WHEN k % 2 = 0 THEN 'cardiology' END"), ("device", "vendor", _text("k % 9", "vendor ")), ("medication", "safety_tier", "CASE WHEN k % 3 = 0 THEN 'high_alert' END"), ("payer", "region", "CASE WHEN k % 2 = 0 THEN 'north' END"),
)
_WITH_REFERENCE = "event_id % 4 = 0"

_FIELDS = {n: e for fields in CLINICAL.values() for n, e in fields.items()} | {n: e for _, name, system in MAPPINGS for n, e in _mapping(name, system).items()}
_EV = "ev AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in (_FIELDS | ENVELOPE).items()) + f", {_WITH_REFERENCE} AS referred, " + ", ".join(f"{e} AS {kind}_{f}" for kind, f, e in REFERENCES) + " FROM (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"
# DuckDB reads a column of the inner table before an alias, so names that both have are told apart there.
_EV = _EV.replace("CAST(floor(value) AS STRING) AS value", "CAST(CAST(floor(value) AS DOUBLE) AS STRING) AS measured")


def clinical_events(spark: SparkSession, sf_dir: str, *types: str, known: DataFrame | None = None) -> DataFrame:
    """Enriched clinical events with ``payload_json``, and ``payload`` parsed from it; of some types or all.

    ``known``: events that are parsed already (``read_once``), from which those of the types are taken.
    """
    if known is not None:
        return known.where(F.col("event_type").isin(*types)) if types else known
    return clinical(table(spark, sf_dir, "events"), *types)


def clinical(raw: DataFrame, *types: str, score: bool = False) -> DataFrame:
    """The same of some rows of ``events``; ``score``: with the number that their properties have."""
    raw = raw.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.expr(ENVELOPE["type"])
    if types:
        raw = raw.where(kind.isin(*types))
    fields = [F.when(kind == t, F.expr(e)).alias(n) for t, of in CLINICAL.items() for n, e in of.items()]
    tree: dict = {}
    for path, name, system in MAPPINGS:
        made = _mapping(name, system)
        at = tree
        for part in path.split(".")[:-1]:
            at = at.setdefault(part, {})
        at[path.split(".")[-1]] = F.struct(F.expr(made[f"{name}_system"]).alias("standard_system"), F.expr(made[f"{name}_code"]).alias("standard_code"), F.expr(made[f"{name}_display"]).alias("display"))
    packed = lambda node: F.struct(*[(packed(v) if isinstance(v, dict) else v).alias(n) for n, v in node.items()])
    known: dict[str, list] = {}
    for of, field, e in REFERENCES:
        known.setdefault(of, []).append(F.expr(e).alias(field))
    reference = F.when(F.expr(_WITH_REFERENCE), F.struct(*[F.struct(*fs).alias(of) for of, fs in known.items()]))
    payload = F.to_json(F.struct(*fields, packed(tree).alias("semantic"), reference.alias("reference_data")))
    events = raw.select(
        F.col("event_id").alias("arrival_seq"), F.expr(ENVELOPE["id"]).alias("event_id"), F.expr(ENVELOPE["stamp"]).alias("event_ts"), F.lit("web").alias("source_system"), F.expr(ENVELOPE["source_type"]).alias("source_type"), kind.alias("event_type"),
        *[F.expr(ENVELOPE[c]).alias(c) for c in ("patient_id", "encounter_id", "provider_id")], F.expr(ENVELOPE["words"]).alias("text"), F.lit("1.0.0").alias("schema_version"), F.lit("0.1.0").alias("ontology_version"), payload.alias("payload_json"), *[F.col("k").alias("score")] * score,
    )
    return envelopes.with_payload(events, envelopes.clinical_payload())


#: Lines repeat within an order, so part, supplier and price tell them apart.
_SEQ = "(((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 30011 + l_partkey) * 1009 + l_suppkey) * 127 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 127"
#: Supply-chain events from lineitems: each type is a part of them.
SUPPLY_ENVELOPE = {
    "seq": _SEQ,
    "id": f"concat('sc-', CAST({_SEQ} AS STRING))",
    "stamp": "CAST(date_trunc('second', CAST(l_shipdate AS TIMESTAMP)) AS STRING)",
    "type": "CASE l_linenumber % 5 WHEN 0 THEN 'INVENTORY_LEVEL' WHEN 1 THEN 'PURCHASE_ORDER' WHEN 2 THEN 'SHIPMENT_UPDATE' WHEN 3 THEN 'QUALITY_RESULT' ELSE 'DISRUPTION_ALERT' END",
}
SUPPLY = {
    "supplier_id": f"CASE WHEN l_orderkey % 10 > 0 THEN {_text('l_suppkey', 's-')} END",
    "part_id": _text("l_partkey", "part-"),
    "facility_id": _text("l_orderkey % 37", "fac-"),
    "part_name": f"CASE WHEN l_orderkey % 2 = 0 THEN {_text('l_orderkey', 'made in ')} END",
    "po_number": _text("l_orderkey % 401", "po-"),
    "quantity": "CAST(l_quantity AS INT)",
    "status": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END",
    "destination_facility": _text("l_orderkey % 41", "fac-"),
    "origin_facility": f"CASE WHEN l_orderkey % 3 > 0 THEN {_text('l_orderkey % 43', 'fac-')} END",
    "shipment_id": _text("l_orderkey % 307", "sh-"),
    "container_id": _text("l_partkey % 11", "box "),
    "customs_cleared": "l_returnflag = 'N'",
    "inspection_id": _text("l_orderkey % 205", "qi-"),
    "defects_found": "CAST(l_quantity AS INT) % 7",
    "result": "CASE WHEN l_discount > 0.05 THEN 'fail' ELSE 'pass' END",
    "disruption_id": _text("l_orderkey % 50", "d-"),
    "severity": "CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END",
    "region": "CASE WHEN l_orderkey % 4 > 0 THEN concat('region ', CAST(l_orderkey % 5 AS STRING)) END",
    "on_hand_qty": "CAST(l_quantity AS INT)",
    "below_reorder": "l_quantity < 10",
}
_AFFECTED = "[concat('part-', CAST(l_partkey AS STRING)), CASE WHEN l_orderkey % 2 = 0 THEN concat('part-', CAST(l_partkey + 1 AS STRING)) END]"
_SC = "sc AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in (SUPPLY_ENVELOPE | SUPPLY).items()) + f", {_AFFECTED} AS affected FROM lineitem)"


def supply_events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Supply-chain events with ``payload``; of some types or all."""
    kind = F.expr(SUPPLY_ENVELOPE["type"])
    raw = table(spark, sf_dir, "lineitem")
    if types:
        raw = raw.where(kind.isin(*types))
    affected = F.array(F.expr(SUPPLY["part_id"]), F.when(F.expr("l_orderkey % 2 = 0"), F.concat(F.lit("part-"), (F.col("l_partkey") + 1).cast("string"))))
    payload = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in SUPPLY.items()], affected.alias("affected_parts")))
    column = lambda n: F.expr(SUPPLY[n])
    events = raw.select(
        F.expr(SUPPLY_ENVELOPE["seq"]).alias("arrival_seq"), F.expr(SUPPLY_ENVELOPE["id"]).alias("event_id"), F.expr(SUPPLY_ENVELOPE["stamp"]).alias("event_ts"), F.lit("ERP").alias("source_system"), F.lit("ERP").alias("source_type"), kind.alias("event_type"),
        column("part_id").alias("entity_id"), column("facility_id").alias("facility_id"), column("supplier_id").alias("supplier_id"), F.lit("1").alias("schema_version"), F.lit("said").alias("text"), payload.alias("payload_json"),
    )
    return envelopes.with_payload(events, envelopes.supply_payload())


# -- Write programs -----------------------------------------------------------------------------------

GRAPH_COLUMNS = ("kind", "src_label", "src", "dst_label", "dst", "tag", "props")


def _shown(events: DataFrame, program: tuple) -> DataFrame:
    """The graph that a program leaves of events: nodes (empty kind) and edges, with their properties as text."""
    return shown_graph(graph.folded_events(events, program), graph.matches(program))


def shown_graph(folded: DataFrame, matched: bool = True) -> DataFrame:
    """The same of a folded graph; ``matched`` as for ``graph.present``."""
    return graph.present(folded, matched).withColumn("props", graph.shown())


def _props_sql(seq: str, props: dict[str, str], keep: dict[str, str], once: dict[str, str], again: dict[str, str]) -> str:
    made = {n: f"arg_max_null({e}, {seq})" for n, e in props.items()} | {n: f"arg_max({e}, {seq})" for n, e in keep.items()}
    made |= {n: f"arg_min_null({e}, {seq})" for n, e in once.items()} | {n: f"CASE WHEN count(DISTINCT {seq}) > 1 THEN arg_max_null({e}, {seq}) END" for n, e in again.items()}
    return "concat_ws(';', " + ", ".join(f"'{n}=' || CAST({made[n]} AS VARCHAR)" for n in sorted(made)) + ")" if made else "''"


def _node(label: str, key: str, where: str = "true", props: dict | None = None, keep: dict | None = None, once: dict | None = None, again: dict | None = None, source: str = "ev") -> str:
    """SQL of a MERGE of a node and what it sets: always, if known, on create, on match."""
    made = _props_sql("seq", props or {}, keep or {}, once or {}, again or {})
    return f"SELECT '' AS kind, '{label}' AS src_label, {key} AS src, '' AS dst_label, '' AS dst, '' AS tag, {made} AS props FROM {source} WHERE ({where}) AND {key} IS NOT NULL GROUP BY {key}"


def _edge(kind: str, src: tuple[str, str], dst: tuple[str, str], where: str = "true", props: dict | None = None, once: dict | None = None, tag: str = "''", source: str = "ev") -> str:
    made = _props_sql("seq", props or {}, {}, once or {}, {})
    return f"SELECT '{kind}', '{src[0]}', {src[1]}, '{dst[0]}', {dst[1]}, {tag}, {made} FROM {source} WHERE ({where}) AND {src[1]} IS NOT NULL AND {dst[1]} IS NOT NULL GROUP BY {src[1]}, {dst[1]}, {tag}"


def _merged(*parts: str, ctes: str = _EV) -> str:
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(parts)


def _of(kind: str) -> str:
    return f"type = '{kind}'"


_P, _E = ("Patient", "patient_id"), ("ClinicalEvent", "id")
_SOURCE = {"provenance_source_type": "source_type"}


def _std(name: str, prefix: str = "", fields: tuple[str, ...] = ("system", "code", "display")) -> dict[str, str]:
    shown = {"system": "standard_system", "code": "standard_code", "display": "display"}
    return {f"{prefix}{shown[f]}": f"{name}_{f}" for f in fields}


_BASE_SQL = (
    _node("Patient", "patient_id"), _node("SourceSystem", "'web'", props={"type": "source_type"}),
    _node("ClinicalEvent", "id", props={"event_type": "type", "event_ts": "stamp", "text": "words", "schema_version": "'1.0.0'", "ontology_version": "'0.1.0'"} | _SOURCE),
    _edge("ABOUT_PATIENT", _E, _P), _edge("FROM_SOURCE", _E, ("SourceSystem", "'web'")),
    _node("Encounter", "encounter_id"), _edge("DURING_ENCOUNTER", _E, ("Encounter", "encounter_id")),
    _node("Provider", "provider_id", "encounter_id IS NOT NULL"), _edge("SEEN_BY", ("Encounter", "encounter_id"), ("Provider", "provider_id")),
)


@query(_merged(*_BASE_SQL))
def graph_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M01, M18] What every clinical event writes, typed properties and all."""
    return _shown(clinical_events(spark, sf_dir), graph.CLINICAL_BASE)


@query(f"SELECT src_label AS label, src AS key, CASE src_label WHEN 'SourceSystem' THEN (SELECT arg_max(upper(event_type), event_id) FROM events) WHEN 'ClinicalEvent' THEN (SELECT type FROM ev WHERE id = src) END AS type FROM ({_merged(*_BASE_SQL).split(chr(10), 1)[1]}) WHERE kind = ''".join(("WITH " + _EV + "\n", "")))
def base_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M01, M18, F05, J19] Nodes that all events leave; one row per label and key."""
    nodes = graph.nodes_of(graph.folded(graph.writes(clinical_events(spark, sf_dir), graph.CLINICAL_BASE), graph.CLINICAL_BASE))
    kind = F.coalesce(F.try_element_at("props", F.lit("type")), F.try_element_at("props", F.lit("event_type")))
    return nodes.select("label", "key", kind.cast("string").alias("type"))


@query("WITH " + _EV + f"\nSELECT kind, src, dst FROM ({_merged(*_BASE_SQL).split(chr(10), 1)[1]}) WHERE kind <> ''")
def base_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M01, S10] Edges that all events leave; one row per identity.  An encounter is seen by a provider."""
    return graph.edges_of(graph.folded(graph.writes(clinical_events(spark, sf_dir), graph.CLINICAL_BASE), graph.CLINICAL_BASE), graph.matches(graph.CLINICAL_BASE)).select("kind", "src", "dst")


def _typed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _shown(clinical_events(spark, sf_dir, kind), graph.CLINICAL[kind])


_C, _S = ("Condition", "diagnosis"), ("Symptom", "symptom")
_NOTE = _of("CLINICAL_NOTE")
_ALLERGIC = f"{_NOTE} AND event_family = 'ALLERGY_INTOLERANCE' AND allergen <> ''"
_AE = ("AdverseEvent", "'ae-allergy-' || id")


@query(
    _merged(
        _node("Condition", "diagnosis", _NOTE, keep=_std("condition") | _SOURCE, once={"first_seen_ts": "stamp"}, again={"last_seen_ts": "stamp"}), _node("Symptom", "symptom", _NOTE, keep=_std("symptom") | _SOURCE),
        _node("Patient", "patient_id", f"{_NOTE} AND (diagnosis IS NOT NULL OR symptom IS NOT NULL OR ({_ALLERGIC}))"), _node("ClinicalEvent", "id", f"{_NOTE} AND (diagnosis IS NOT NULL OR symptom IS NOT NULL OR ({_ALLERGIC}))"),
        _edge("HAS_CONDITION", _P, _C, _NOTE, once={"onset_ts": "stamp"}), _edge("HAS_SYMPTOM", _P, _S, _NOTE), _edge("DOCUMENTS", _E, _C, _NOTE), _edge("DOCUMENTS", _E, _S, _NOTE),
        _node("ICD10Code", "icd10_code", _NOTE, props={"standard_system": "'ICD10'"}, keep={"display": "icd10_code"}), _edge("CODED_AS", _C, ("ICD10Code", "icd10_code"), _NOTE),
        _node("AdverseEvent", "'ae-allergy-' || id", _ALLERGIC, once={"symptom_name": "symptom", "detected_ts": "stamp", "source_event_id": "id", "severity": "coalesce(reaction_severity, 'unknown')", "meddra_term": "diagnosis", "allergen": "allergen", "event_family": "'ALLERGY_INTOLERANCE'"}),
        _edge("REPORTED_ADVERSE_REACTION", _P, _AE, _ALLERGIC), _edge("TRIGGERED_BY_EVENT", _AE, _E, _ALLERGIC),
    )
)
def graph_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M03, M10, W03, W04] Clinical notes, their allergies included; no medication is there to be tied to."""
    return _typed(spark, sf_dir, "CLINICAL_NOTE")


_TIED = "ASSOCIATED_WITH_MEDICATION"


@query(f"""WITH {_EV}, drugs AS (SELECT medication, min(seq) AS born FROM ev WHERE {_of('MEDICATION_ORDER')} GROUP BY 1)
SELECT '{_TIED}' AS kind, 'ae-allergy-' || id AS src, allergen AS dst FROM ev JOIN drugs ON drugs.medication = allergen AND born < seq
WHERE {_ALLERGIC} AND allergen IN {graph.ALLERGENS}""")
def graph_allergy_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M10, J15] Allergies tied to medications that an earlier event had ordered."""
    program = graph.program_of((), {k: graph.CLINICAL[k] for k in ("CLINICAL_NOTE", "MEDICATION_ORDER")})
    _, edges = graph.build(clinical_events(spark, sf_dir, "CLINICAL_NOTE", "MEDICATION_ORDER"), program)
    return edges.where(F.col("kind") == _TIED).select("kind", "src", "dst")


_LAB, _O = _of("LAB_RESULT"), ("Observation", "id")


@query(_merged(_node("Observation", "id", _LAB, props={"name": "lab_name", "value": "measured", "abnormal": "coalesce(abnormal, false)", "event_ts": "stamp", "unit": "unit", "specimen_type": "specimen_type"}, keep=_std("observation") | _SOURCE), _node("Patient", "patient_id", _LAB), _node("ClinicalEvent", "id", _LAB), _edge("HAS_OBSERVATION", _P, _O, _LAB), _edge("DOCUMENTS", _E, _O, _LAB)))
def graph_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M04] Laboratory results; values are numbers, ``abnormal`` defaults to false."""
    return _typed(spark, sf_dir, "LAB_RESULT")


def values_sql(text: str, columns: str, name: str) -> str:
    """A fixed table as SQL values; empty cells are null."""
    quoted = lambda c: "NULL" if not c else "'" + c.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in ontology.rows_of(text)) + f") AS {name}({', '.join(columns.split())})"


_LAB_RULES = values_sql(ontology.LAB_RULES, "rule_id observation operator bound unit condition reason severity", "r")
_FIRES = "lower(lab_name) = lower(r.observation) AND CASE r.operator WHEN 'gt' THEN CAST(measured AS DOUBLE) > CAST(r.bound AS DOUBLE) WHEN 'gte' THEN CAST(measured AS DOUBLE) >= CAST(r.bound AS DOUBLE) ELSE CAST(measured AS DOUBLE) < CAST(r.bound AS DOUBLE) END"
_FIRED = f"fired AS (SELECT ev.seq, ev.id, ev.patient_id, lab_name, measured, r.unit, r.rule_id, r.condition, r.reason, r.severity FROM ev JOIN {_LAB_RULES} ON {_LAB} AND {_FIRES})"


def lab_signals(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Laboratory results joined with the rules of the clinical pack that fire."""
    labs = clinical_events(spark, sf_dir, "LAB_RESULT", known=known).select("arrival_seq", "event_id", "patient_id", "payload.lab_name", "payload.value")
    return rules.threshold_signals(labs, ontology.lab_rules(spark), "lab_name", "value")


@query(_merged(_node("Observation", "id", source="fired"), _node("Condition", "condition", source="fired"), _edge("MAY_INDICATE", _O, ("Condition", "condition"), props={"rule_id": "rule_id", "reason": "reason"}, tag="reason", source="fired"), ctes=f"{_EV}, {_FIRED}"))
def graph_lab_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M05] What fired laboratory rules write; an edge for each reason."""
    program = tuple(i for i in graph.CLINICAL["LAB_RESULT"] if getattr(i, "kind", "") == "MAY_INDICATE")
    fired = lab_signals(spark, sf_dir).withColumn("signals", F.array(F.struct("condition", "reason", "rule_id")))
    return _shown(fired, program)


_VITAL, _R = _of("VITAL_SIGN"), ("DeviceReading", "id")


@query(_merged(_node("Device", "device_id", _VITAL, keep={"device_type": "device_type"}), _node("DeviceReading", "id", _VITAL, props={"event_ts": "stamp", "heart_rate": "heart_rate", "systolic_bp": "systolic_bp", "diastolic_bp": "diastolic_bp", "alert": "alert"}), _node("Patient", "patient_id", _VITAL), _node("ClinicalEvent", "id", _VITAL), _edge("HAS_DEVICE_READING", _P, _R, _VITAL), _edge("MEASURED_BY", _R, ("Device", "device_id"), _VITAL), _edge("DOCUMENTS", _E, _R, _VITAL)))
def graph_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M06] Device readings; a device keeps the type it is known by."""
    return _typed(spark, sf_dir, "VITAL_SIGN")


_MED, _M, _MO = _of("MEDICATION_ORDER"), ("Medication", "medication"), ("MedicationOrder", "id")


@query(_merged(_node("Medication", "medication", _MED, keep={"drug_class": "drug_class"} | _std("drug") | _SOURCE), _node("MedicationOrder", "id", _MED, props={n: n for n in ("dose", "route", "order_type", "days_supply")} | {"event_ts": "stamp"}), _node("Patient", "patient_id", _MED), _node("ClinicalEvent", "id", _MED), _edge("ORDERS_MEDICATION", _MO, _M, _MED), _edge("HAS_MEDICATION_ORDER", _P, _MO, _MED), _edge("DOCUMENTS", _E, _MO, _MED)))
def graph_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M07] Medication orders, a node for each event."""
    return _typed(spark, sf_dir, "MEDICATION_ORDER")


_CLAIM, _CL = _of("CLAIM_STATUS"), ("Claim", "claim_id")
_CLAIM_RULES = values_sql(ontology.CLAIM_RULES, "rule_id claim_type codes outcome severity", "r")
_CLAIM_FIRES = "(r.claim_type IS NULL OR r.claim_type = ev.claim_type) AND (r.codes IS NULL OR list_contains(string_split(r.codes, ' '), ev.procedure_code))"
_RESULTED = f"resulted AS (SELECT ev.seq, ev.id, ev.claim_id, r.outcome, r.rule_id FROM ev JOIN {_CLAIM_RULES} ON {_CLAIM} AND {_CLAIM_FIRES}), last_rule AS (SELECT seq, claim_id, outcome, arg_max(rule_id, place) AS rule_id FROM (SELECT resulted.*, o.place FROM resulted JOIN (SELECT unnest({[r[0] for r in ontology.rows_of(ontology.CLAIM_RULES)]}) AS rid, generate_subscripts({[r[0] for r in ontology.rows_of(ontology.CLAIM_RULES)]}, 1) AS place) o ON o.rid = rule_id) GROUP BY ALL)"


def claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims joined with the rules of the clinical pack that fire."""
    claims = clinical_events(spark, sf_dir, "CLAIM_STATUS").select("arrival_seq", "event_id", "payload.claim_id", "payload.claim_type", "payload.procedure_code")
    return rules.wildcard_signals(claims, ontology.claim_rules(spark), "claim_type", "procedure_code")


@query(
    _merged(
        _node("Claim", "claim_id", _CLAIM, props={n: n for n in ("status", "claim_type", "diagnosis_code", "billed_amount")} | {"event_ts": "stamp"}, keep=_std("diagnosed", "diagnosis_", ("system",)) | _std("done", "procedure_", ("system",)) | _SOURCE),
        _node("Patient", "patient_id", _CLAIM), _node("ClinicalEvent", "id", _CLAIM), _edge("HAS_CLAIM", _P, _CL, _CLAIM), _edge("DOCUMENTS", _E, _CL, _CLAIM),
        _node("Procedure", "procedure_code", _CLAIM, keep=_std("done", "", ("system", "display")) | _SOURCE, once={"description": "procedure_description"}), _edge("FOR_PROCEDURE", _CL, ("Procedure", "procedure_code"), _CLAIM),
        _node("Payer", "payer", _CLAIM), _edge("SUBMITTED_TO", _CL, ("Payer", "payer"), _CLAIM),
        _node("AdverseOutcome", "outcome", source="last_rule"), _edge("RESULTED_IN", _CL, ("AdverseOutcome", "outcome"), props={"rule_id": "rule_id"}, source="last_rule"), ctes=f"{_EV}, {_RESULTED}",
    )
)
def graph_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M08, K6] Claims with the outcomes that rules gave them; of rules with one outcome the last by place."""
    claims = clinical_events(spark, sf_dir, "CLAIM_STATUS")
    place = {row[0]: i for i, row in enumerate(ontology.rows_of(ontology.CLAIM_RULES))}
    found = claim_outcomes(spark, sf_dir).withColumn("place", F.create_map(*[F.lit(x) for p in place.items() for x in p])[F.col("rule_id")])
    last = found.groupBy("event_id", "outcome").agg(F.max_by("rule_id", "place").alias("rule_id"))
    # At most one for each rule of the pack.
    outcomes = last.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("outcome", "rule_id"))).alias("outcomes"))
    return _shown(claims.join(outcomes, "event_id", "left"), graph.CLINICAL["CLAIM_STATUS"])


_REF = "referred"
_REF_SQL = (
    _node("Patient", "patient_id", f"({_REF})", keep={n: f"patient_{n}" for n in ("name", "sex", "age", "risk_tier")}),
    _node("Provider", "provider_id", _REF, keep={"specialty": "provider_specialty"} | _SOURCE), _edge("MANAGED_BY", _P, ("Provider", "provider_id"), _REF),
    _node("Device", "device_id", f"{_REF} AND {_VITAL}", keep={"vendor": "device_vendor"} | _SOURCE), _edge("REGISTERED_DEVICE", _P, ("Device", "device_id"), f"{_REF} AND {_VITAL}"),
    _node("Medication", "medication", f"{_REF} AND {_MED}", keep={"safety_tier": "medication_safety_tier"}), _edge("KNOWN_MEDICATION", _P, _M, f"{_REF} AND {_MED}"),
    _node("Payer", "payer", f"{_REF} AND {_CLAIM}", keep={"region": "payer_region"} | _SOURCE), _edge("COVERED_BY", _P, ("Payer", "payer"), f"{_REF} AND {_CLAIM}"),
)


@query(_merged(*_REF_SQL))
def graph_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M02, K5] Reference data of events: nodes that keep what is known, and edges from the patient."""
    return _shown(clinical_events(spark, sf_dir), graph.CLINICAL_REFERENCE)


_REACTIONS = values_sql(ontology.REACTIONS, "medication symptom severity meddra_term", "kr")
_ADVERSE = f"""ordered AS (SELECT patient_id, medication, min(seq) AS first_seq FROM ev WHERE {_MED} GROUP BY ALL),
met AS (SELECT n.seq, n.id, n.patient_id, n.stamp, n.symptom, kr.medication AS drug, kr.severity AS how, kr.meddra_term AS term FROM ev n JOIN {_REACTIONS} ON {_NOTE} AND kr.symptom = n.symptom
JOIN ordered o ON o.patient_id = n.patient_id AND o.medication = kr.medication AND o.first_seq < n.seq),
adverse AS (SELECT *, 'ae-' || id AS ae, first_value(how) OVER w AS severity_first, first_value(term) OVER w AS term_first FROM met WINDOW w AS (PARTITION BY id ORDER BY drug))"""
_A = ("AdverseEvent", "ae")


def adverse_events(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Notes that report a known reaction to a drug their patient had ordered before."""
    events = clinical_events(spark, sf_dir, "CLINICAL_NOTE", "MEDICATION_ORDER", known=known)
    notes = events.where("event_type = 'CLINICAL_NOTE'").select(F.col("event_id").alias("note_id"), "patient_id", "payload.symptom", F.col("arrival_seq").alias("seq"))
    orders = events.where("event_type = 'MEDICATION_ORDER'").select("patient_id", "payload.medication", F.col("arrival_seq").alias("seq"))
    stamps = events.where("event_type = 'CLINICAL_NOTE'").select(F.col("event_id").alias("note_id"), "event_ts", "arrival_seq")
    return rules.adverse_matches(notes, orders, ontology.reactions(spark)).join(stamps, "note_id")


@query(
    _merged(
        _node("AdverseEvent", "ae", source="adverse", once={"symptom_name": "symptom", "detected_ts": "stamp", "source_event_id": "id", "severity": "severity_first", "meddra_term": "term_first"}), _node("Patient", "patient_id", source="adverse"), _node("Medication", "drug", source="adverse"),
        _node("ClinicalEvent", "id", source="adverse"), _edge("REPORTED_ADVERSE_REACTION", _P, _A, source="adverse"), _edge("ASSOCIATED_WITH_MEDICATION", _A, ("Medication", "drug"), source="adverse"), _edge("TRIGGERED_BY_EVENT", _A, _E, source="adverse"), ctes=f"{_EV}, {_ADVERSE}",
    )
)
def graph_adverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M09, R04, J14] Adverse events and what they are tied to; severity and term are those of the first drug by name."""
    return _shown(adverse_events(spark, sf_dir), graph.ADVERSE)


_SE = ("SupplyChainEvent", "id")


@query(
    _merged(
        _node("SourceSystem", "'ERP'", source="sc", props={"type": "'ERP'"}), _node("SupplyChainEvent", "id", source="sc", props={"event_type": "type", "event_ts": "stamp", "text": "'said'", "schema_version": "'1'"}), _edge("FROM_SOURCE", _SE, ("SourceSystem", "'ERP'"), source="sc"),
        _node("Part", "part_id", source="sc"), _edge("ABOUT_PART", _SE, ("Part", "part_id"), source="sc"), _node("Facility", "facility_id", source="sc"), _edge("AT_FACILITY", _SE, ("Facility", "facility_id"), source="sc"),
        _node("Supplier", "supplier_id", source="sc"), _edge("INVOLVES_SUPPLIER", _SE, ("Supplier", "supplier_id"), source="sc"), ctes=_SC,
    )
)
def graph_supply_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M11] What every supply-chain event writes."""
    return _shown(supply_events(spark, sf_dir), graph.SUPPLY_BASE)


def _supplied(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _shown(supply_events(spark, sf_dir, kind), graph.SUPPLY[kind])


def _sc(kind: str, *items: tuple) -> str:
    """SQL of a supply-chain program: (label, key, props, keep) for nodes, (kind, src, dst[, props]) for edges."""
    parts = []
    for item in items:
        if isinstance(item[1], tuple):
            parts.append(_edge(item[0], item[1], item[2], _of(kind), props=item[3] if len(item) > 3 else None, source="sc"))
        else:
            parts.append(_node(item[0], item[1], _of(kind), *item[2:], source="sc"))
    return _merged(*parts, ctes=_SC)


def _same(*names: str, **other: str) -> dict[str, str]:
    return {n: n for n in names} | other


_SU, _PA, _FA, _TO = ("Supplier", "supplier_id"), ("Part", "part_id"), ("Facility", "facility_id"), ("Facility", "destination_facility")
_PO, _SH, _QI, _DI = ("PurchaseOrder", "po_number"), ("Shipment", "shipment_id"), ("QualityInspection", "inspection_id"), ("DisruptionEvent", "disruption_id")


@query(_sc("PURCHASE_ORDER", _SU, (*_PA, None, {"name": "part_name"}), _TO, (*_PO, _same("quantity", "status", event_ts="stamp")), ("ORDERED_FROM", _PO, _SU), ("ORDERS_PART", _PO, _PA), ("DELIVERS_TO", _PO, _TO), ("SUPPLIES", _SU, _PA)))
def graph_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M12]"""
    return _supplied(spark, sf_dir, "PURCHASE_ORDER")


_SHIPPED = _of("SHIPMENT_UPDATE")


@query(_sc("SHIPMENT_UPDATE", _SU, _PA, (*_SH, _same("status", "quantity", "container_id", "customs_cleared", event_ts="stamp")), ("SHIPPED_TO", _SH, _TO), ("SHIPPED_FROM", _SH, ("Facility", "origin_facility")), ("CONTAINS_PART", _SH, _PA), ("FROM_SUPPLIER", _SH, _SU)) + f"\nUNION ALL SELECT '', 'Facility', f, '', '', '', '' FROM (SELECT destination_facility AS f FROM sc WHERE {_SHIPPED} UNION SELECT origin_facility FROM sc WHERE {_SHIPPED}) WHERE f IS NOT NULL")
def graph_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M13]"""
    return _supplied(spark, sf_dir, "SHIPMENT_UPDATE")


@query(_sc("QUALITY_RESULT", _SU, _PA, _FA, (*_QI, _same("defects_found", "result", event_ts="stamp")), ("INSPECTED_PART", _QI, _PA), ("INSPECTED_AT", _QI, _FA), ("SUPPLIED_BY", _QI, _SU)))
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M14]"""
    return _supplied(spark, sf_dir, "QUALITY_RESULT")


_HIT = f"hit AS (SELECT seq, disruption_id, unnest(affected) AS part FROM sc WHERE {_of('DISRUPTION_ALERT')})"


@query(_sc("DISRUPTION_ALERT", (*_FA, None, {"region": "region"}), (*_DI, _same("severity", "region", event_ts="stamp")), ("DISRUPTED_BY", _FA, _DI)).replace(_SC, f"{_SC}, {_HIT}") + "\nUNION ALL " + _node("Part", "part", source="hit") + "\nUNION ALL " + _edge("AFFECTS_PART", _DI, ("Part", "part"), source="hit"))
def graph_disruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M15, J13] An alert also tells the region of its facility."""
    return _supplied(spark, sf_dir, "DISRUPTION_ALERT")


@query(_sc("INVENTORY_LEVEL", _FA, _PA, ("HOLDS_INVENTORY", _FA, _PA, _same("on_hand_qty", "below_reorder", updated_ts="stamp"))))
def graph_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M16]"""
    return _supplied(spark, sf_dir, "INVENTORY_LEVEL")


_REFERENCE_ROWS = {
    "SUPPLIER": ("supplier", {"supplier_id": _text("s_suppkey % 40", "s-"), "name": "s_name", "tier": "CAST(s_nationkey AS INT)", "risk_score": "CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS DOUBLE) + 0.5 END"}, "s_suppkey"),
    "PART": ("part", {"part_id": _text("p_partkey % 90", "part-"), "part_name": "p_name", "criticality": "CASE WHEN p_size > 25 THEN 'critical' END", "lead_time_days": "CAST(p_size AS INT)", "single_source": "p_size % 2 = 0"}, "p_partkey"),
    "FACILITY": ("nation", {"facility_id": _text("n_regionkey", "fac-"), "name": "n_name", "operational_status": "CASE WHEN n_nationkey % 2 = 0 THEN 'open' END"}, "n_nationkey"),
}
_KNOWN = {"SUPPLIER": ("Supplier", "supplier_id", {"name": "name", "tier": "tier", "risk_score": "risk_score"}), "PART": ("Part", "part_id", {"name": "part_name", "criticality": "criticality", "lead_time_days": "lead_time_days", "single_source": "single_source"}), "FACILITY": ("Facility", "facility_id", {"name": "name", "operational_status": "operational_status"})}


@query("\nUNION ALL ".join(_node(label, key, keep=keep, source=f"(SELECT {seq} AS seq, " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {name})") for (name, fields, seq), (label, key, keep) in zip(_REFERENCE_ROWS.values(), _KNOWN.values())))
def graph_supply_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M17] Reference records of suppliers, parts and facilities; a null never replaces what is known."""
    written, program = [], ()
    for kind, (name, fields, seq) in _REFERENCE_ROWS.items():
        rows = table(spark, sf_dir, name).select(F.expr(seq).alias("arrival_seq"), F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])).alias("payload_json"))
        written.append(graph.writes(envelopes.with_payload(rows, envelopes.REFERENCE_PAYLOADS[kind]), graph.SUPPLY_REFERENCE[kind], first=len(program)))
        program += graph.SUPPLY_REFERENCE[kind]
    return shown_graph(graph.folded(patterns.together(*written), program), graph.matches(program))


# -- Rule packs, seeds and lookups --------------------------------------------------------------------


@query(f"WITH {_EV}, {_FIRED} SELECT rule_id, condition, severity, count(*) AS n, count(DISTINCT patient_id) AS patients FROM fired GROUP BY ALL")
def lab_rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R01, F06, F07] How often each laboratory rule of the clinical pack fires."""
    return lab_signals(spark, sf_dir).groupBy("rule_id", "condition", "severity").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


_OUTCOMES = values_sql(ontology.OUTCOMES, "code description", "o")


@query(f"WITH {_EV}, {_RESULTED} SELECT rule_id, outcome, description, count(*) AS n FROM resulted LEFT JOIN {_OUTCOMES} ON o.code = outcome GROUP BY ALL")
def claim_rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R02, R06] How often each claim rule fires, with the description of its outcome."""
    counted = claim_outcomes(spark, sf_dir).groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))
    return counted.join(ontology.outcomes(spark), F.col("code") == F.col("outcome"), "left").select("rule_id", "outcome", "description", "n")


_INTERACTIONS = values_sql(ontology.INTERACTIONS, "drug_a drug_b risk severity mechanism", "i")
_ACTIVE = f"active AS (SELECT patient_id, medication FROM ev WHERE {_MED} AND order_type NOT IN ('discontinued', 'hold'))"


def _orders(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """(owner, item, state) of medication orders."""
    return clinical_events(spark, sf_dir, "MEDICATION_ORDER", known=known).select(F.col("patient_id").alias("owner"), F.col("payload.medication").alias("item"), F.col("payload.order_type").alias("state"))


@query(f"WITH {_EV}, {_ACTIVE} SELECT i.drug_a, i.drug_b, i.risk, i.severity, count(DISTINCT a.patient_id) AS patients FROM {_INTERACTIONS} JOIN active a ON a.medication = i.drug_a JOIN active b ON b.patient_id = a.patient_id AND b.medication = i.drug_b GROUP BY ALL")
def interaction_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R03, F04, J12] Patients with active orders of both drugs of an interaction."""
    links = ontology.interactions(spark).withColumnsRenamed({"drug_a": "item_a", "drug_b": "item_b"})
    once = _orders(spark, sf_dir).where(patterns.active(F.col("state"))).distinct()
    pairs = patterns.diamond(once.select("owner", "item").distinct().withColumn("state", F.lit("active")), links)
    return pairs.groupBy(F.col("item_a").alias("drug_a"), F.col("item_b").alias("drug_b"), "risk", "severity").agg(F.count_distinct("owner").alias("patients"))


_CONTRA_RULES = values_sql(ontology.CONTRAINDICATIONS, "medication condition reason severity", "c")
_VIOLATED = f"violated AS (SELECT DISTINCT n.patient_id, c.medication, c.condition, c.reason, c.severity FROM ev n JOIN {_CONTRA_RULES} ON {_NOTE.replace('type', 'n.type')} AND n.diagnosis = c.condition WHERE EXISTS (SELECT 1 FROM ev m WHERE m.type = 'MEDICATION_ORDER' AND m.patient_id = n.patient_id AND m.medication = c.medication))"


def violations(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """(patient_id, medication, condition, reason, severity): contraindicated drugs that were ordered all the same."""
    conditions = clinical_events(spark, sf_dir, "CLINICAL_NOTE", known=known).select("patient_id", F.col("payload.diagnosis").alias("condition")).where("condition is not null").distinct()
    told = conditions.join(ontology.contraindications(spark), "condition")
    ordered = _orders(spark, sf_dir, known).select(F.col("owner").alias("patient_id"), F.col("item").alias("medication"))
    return patterns.having(told, ordered, ["patient_id", "medication"]).select("patient_id", "medication", "condition", "reason", "severity")


@query(f"WITH {_EV}, {_VIOLATED} SELECT * FROM violated")
def contraindication_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C34, R05, J11] All of them, without a limit."""
    return violations(spark, sf_dir)


@query(f"WITH {_EV}, {_ADVERSE} SELECT patient_id, id AS event_id, symptom, drug AS medication, severity_first AS severity, term_first AS meddra_term, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY seq DESC, drug) AS INTEGER) AS place FROM adverse")
def adverse_events_by_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C33] Every patient's adverse events, newest first."""
    found = adverse_events(spark, sf_dir).withColumn("newest", -F.col("arrival_seq"))
    placed = patterns.history(found, "patient_id", ["newest", "medication"]).withColumnRenamed("step", "place")
    return placed.select("patient_id", F.col("note_id").alias("event_id"), "symptom", "medication", "severity", "meddra_term", "place")


@query(f"WITH {_EV} SELECT patient_id, id AS event_id, CAST(measured AS DOUBLE) AS value, unit, coalesce(abnormal, false) AS abnormal FROM ev WHERE {_LAB} AND lab_name = 'Potassium' AND CAST(measured AS DOUBLE) >= 5.5")
def hyperkalemia_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C38] Potassium of 5.5 or more."""
    labs = clinical_events(spark, sf_dir, "LAB_RESULT").where("payload.lab_name = 'Potassium'")
    value = F.col("payload.value").try_cast("double")
    return labs.where(value >= 5.5).select("patient_id", "event_id", value.alias("value"), "payload.unit", F.coalesce("payload.abnormal", F.lit(False)).alias("abnormal"))


@query(f"""WITH {_EV}, managed AS (SELECT DISTINCT patient_id, provider_id FROM ev WHERE referred AND provider_id IS NOT NULL), covered AS (SELECT DISTINCT patient_id, payer FROM ev WHERE referred AND {_CLAIM} AND payer IS NOT NULL)
SELECT m.patient_id, m.provider_id, c.payer FROM managed m LEFT JOIN covered c ON c.patient_id = m.patient_id ORDER BY m.patient_id, m.provider_id, c.payer NULLS LAST LIMIT 50""")
def coverage_and_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C40, J08, F17] Who manages a patient, and who covers them if anyone does; the first fifty."""
    _, edges = graph.build(clinical_events(spark, sf_dir), graph.CLINICAL_REFERENCE)
    managed = patterns.without(graph.edge_table(edges, "MANAGED_BY"), "props").withColumnsRenamed({"src": "patient_id", "dst": "provider_id"})
    covered = patterns.without(graph.edge_table(edges, "COVERED_BY"), "props")
    both = patterns.hop(managed, covered, "patient_id", "payer", optional=True)
    return both.orderBy("patient_id", "provider_id", F.col("payer").asc_nulls_last()).limit(50)


_SEEDS = f"""SELECT 'Condition' AS label, x AS key, '' AS props FROM (SELECT unnest({ontology.CONDITION_SEEDS}) AS x UNION SELECT condition FROM {_CONTRA_RULES})
UNION ALL SELECT 'Symptom', x, '' FROM (SELECT unnest({ontology.SYMPTOM_SEEDS}) AS x UNION SELECT symptom FROM {_REACTIONS})
UNION ALL SELECT 'AdverseOutcome', code, 'description=' || description FROM {_OUTCOMES}
UNION ALL SELECT 'Medication', x, CASE WHEN s.name IS NULL THEN '' ELSE 'activeIngredient=' || s.ingredient || ';isValidatedTradeNameUsed=' || s.trade END
FROM (SELECT drug_a AS x FROM {_INTERACTIONS} UNION SELECT drug_b FROM {_INTERACTIONS} UNION SELECT medication FROM {_CONTRA_RULES} UNION SELECT medication FROM {_REACTIONS})
LEFT JOIN {values_sql(ontology.MEDICATION_SEEDS, "name ingredient trade", "s")} ON s.name = x"""


_MENTIONS = f"""mentions AS (SELECT label, key, count(*) AS n FROM (SELECT 'Condition' AS label, diagnosis AS key FROM ev WHERE {_NOTE} UNION ALL SELECT 'Symptom', symptom FROM ev WHERE {_NOTE} UNION ALL SELECT 'Medication', medication FROM ev WHERE {_MED}) GROUP BY ALL)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, key, mentions): conditions, symptoms and medications that events name, and how many do."""
    named = lambda label, field: F.struct(F.lit(label).alias("label"), F.col(f"payload.{field}").alias("key"))
    events = clinical_events(spark, sf_dir, "CLINICAL_NOTE", "MEDICATION_ORDER")
    told = events.select(F.explode(F.array(named("Condition", "diagnosis"), named("Symptom", "symptom"), named("Medication", "medication"))).alias("m")).select("m.*")
    return told.where("key is not null").groupBy("label", "key").agg(F.count("*").alias("mentions"))


@query(f"WITH {_EV}, {_MENTIONS} SELECT s.label, s.key, s.props, coalesce(m.n, 0) AS mentions FROM ({_SEEDS}) s LEFT JOIN mentions m ON m.label = s.label AND m.key = s.key")
def seed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R07, S13, K11] Nodes that are there before any event, and how many events name them; metadata goes to medications that a safety table names."""
    seeds = ontology.seed_nodes(spark).withColumn("props", graph.shown())
    found = seeds.join(mentions(spark, sf_dir), ["label", "key"], "left")
    return found.select("label", "key", "props", F.coalesce("mentions", F.lit(0).cast("long")).alias("mentions"))


@query(f"WITH {_EV}, {_MENTIONS} SELECT s.*, coalesce(m.n, 0) AS mentions FROM (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS links FROM (" + f"SELECT 'INTERACTS_WITH' AS kind, drug_a AS src, drug_b AS dst FROM {_INTERACTIONS} UNION ALL SELECT 'CONTRAINDICATED_FOR', medication, condition FROM {_CONTRA_RULES} UNION ALL SELECT 'HAS_KNOWN_REACTION', medication, symptom FROM {_REACTIONS})) s LEFT JOIN mentions m ON m.label = 'Medication' AND m.key = s.src")
def seed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R03, R04, R05, S13] Edges that are there before any event, and how many orders name their drug."""
    edges = ontology.seed_edges(spark)
    links = edges.join(edges.groupBy("kind", "src").agg(F.count("*").alias("links")), ["kind", "src"])
    ordered = mentions(spark, sf_dir).where("label = 'Medication'").select(F.col("key").alias("src"), "mentions")
    return links.join(ordered, "src", "left").select("kind", "src", "dst", "links", F.coalesce("mentions", F.lit(0).cast("long")).alias("mentions"))


_SOURCES = ("EHR", "LAB", "DEVICE", "PHARMACY", "CLAIMS", "OTHER")


@query(f"SELECT trust_level, phi_class, retention_class, count(*) AS n FROM (SELECT {_cases('event_id % 6', _SOURCES)} AS s FROM events) LEFT JOIN {values_sql(ontology.PROVENANCE, 'source_type trust_level phi_class retention_class', 'p')} ON p.source_type = s GROUP BY ALL")
def provenance_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R08, J04] Events by the provenance class of their source."""
    events = table(spark, sf_dir, "events").select(F.expr(_cases("event_id % 6", _SOURCES)).alias("source_type"))
    return events.join(ontology.provenance(spark), "source_type", "left").groupBy("trust_level", "phi_class", "retention_class").agg(F.count("*").alias("n"))


_VOCABULARY = values_sql(ontology.VOCABULARY, "family local_code standard_system display", "v")


@query(f"WITH {_EV} SELECT lab_name, standard_system, display, count(*) AS n FROM (SELECT '  ' || lab_name || ' ' AS lab_name FROM ev WHERE {_LAB}) LEFT JOIN {_VOCABULARY} ON v.family = 'labs' AND lower(v.local_code) = lower(trim(lab_name)) GROUP BY ALL")
def vocabulary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R09, J03, P03] Laboratory names with their standard terms, without regard to case and white space."""
    labs = clinical_events(spark, sf_dir, "LAB_RESULT").select(F.concat(F.lit("  "), "payload.lab_name", F.lit(" ")).alias("lab_name"))
    found = normalise.mapped(labs, ontology.vocabulary(spark), F.col("lab_name"), "labs", "term")
    return found.groupBy("lab_name", "term.standard_system", "term.display").agg(F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT lab_name, standard_system, display, count(*) AS n FROM ev LEFT JOIN {_VOCABULARY} ON v.family = 'labs' AND lower(v.local_code) = lower(lab_name) WHERE {_LAB} GROUP BY ALL")
def yaml_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S11, R09, J03] Laboratory names with the terms of a directory of YAML mapping files."""
    folder = new_folder(spark, "mappings")
    rows = [dict(zip("family local_code standard_system display".split(), r)) for r in ontology.rows_of(ontology.VOCABULARY)]
    for i, family in enumerate(dict.fromkeys(r["family"] for r in rows)):
        entries = "".join(f"    - {json.dumps({k: v for k, v in r.items() if k != 'family'})}\n" for r in rows if r["family"] == family)
        # The first files are those that later ones take nothing from: a family lies in one of them.
        packs.write_text(spark, f"{folder}/{packs.MAPPING_FILES[i % len(packs.MAPPING_FILES)]}.yaml" if i < len(packs.MAPPING_FILES) else f"{folder}/more/{i}.yaml", f"local_mappings:\n  {family}:\n{entries}")
    labs = clinical_events(spark, sf_dir, "LAB_RESULT").select("payload.lab_name")
    found = normalise.mapped(labs, packs.local_mappings(spark, folder), F.col("lab_name"), "labs", "term")
    return found.groupBy("lab_name", "term.standard_system", "term.display").agg(F.count("*").alias("n"))


_TIERS = values_sql(ontology.REFERENCE_VOCABULARY, "family local_code standard_system standard_code display", "v")


@query(f"WITH {_EV} SELECT e.patient_id, e.id AS event_id, upper(e.patient_sex) AS sex, s.display AS sex_display, t.standard_code AS tier_code, y.standard_system AS specialty_system FROM ev e LEFT JOIN {_TIERS.replace(') AS v(', ') AS s(')} ON s.family = 'patient_sex' AND lower(s.local_code) = lower(e.patient_sex) LEFT JOIN {_TIERS.replace(') AS v(', ') AS t(')} ON t.family = 'patient_risk_tiers' AND lower(t.local_code) = lower(e.patient_risk_tier) LEFT JOIN {_TIERS.replace(') AS v(', ') AS y(')} ON y.family = 'provider_specialties' AND lower(y.local_code) = lower(e.provider_specialty) WHERE referred")
def reference_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P06] Reference data in standard spelling, with three of its eight mappings shown."""
    events = clinical_events(spark, sf_dir).where("payload.reference_data is not null")
    found = normalise.reference_semantics(events, ontology.reference_vocabulary(spark))
    return found.select("patient_id", "event_id", "patient.sex", F.col("patient_sex_mapping.display").alias("sex_display"), F.col("patient_risk_tier_mapping.standard_code").alias("tier_code"), F.col("provider_specialty_mapping.standard_system").alias("specialty_system"))


@query(f"""WITH {_EV} SELECT id AS event_id, upper(procedure_code) AS procedure_code, CASE WHEN procedure_code IS NOT NULL THEN 'CPT' END AS procedure_system, CASE WHEN procedure_code IS NOT NULL THEN procedure_description END AS procedure_display,
CASE WHEN diagnosis_code IS NOT NULL THEN 'ICD10' END AS diagnosis_system, lower(claim_type) AS claim_type FROM ev WHERE {_CLAIM}""")
def claim_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P05, P07] Claims with the mappings of their own codes."""
    found = normalise.semantics(clinical_events(spark, sf_dir, "CLAIM_STATUS"), ontology.vocabulary(spark), "CLAIM_STATUS")
    return found.select("event_id", "payload.procedure_code", F.col("procedure_mapping.standard_system").alias("procedure_system"), F.col("procedure_mapping.display").alias("procedure_display"), F.col("diagnosis_mapping.standard_system").alias("diagnosis_system"), "payload.claim_type")


_LIMITS = ", ".join(f"('{n}', {low if low is not None else 'NULL'}, {high if high is not None else 'NULL'}, {str(closed).lower()})" for n, low, high, closed in ontology.LAB_LIMITS)
_ALL_LABS = tuple(row[0] for row in ontology.LAB_LIMITS)
_MEASURED = f"(SELECT event_id, {_cases(f'event_id % {len(_ALL_LABS) + 1}', (*_ALL_LABS, 'Unknown'))} AS lab, floor(value) AS value FROM events)"


@query(f"SELECT event_id, lab, coalesce(value < l.low OR value > l.high OR (l.closed AND value = l.high), false) AS abnormal FROM {_MEASURED} LEFT JOIN (VALUES {_LIMITS}) AS l(name, low, high, closed) ON l.name = lab")
def lab_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P36] Results outside the limits of their test, for all 36 tests."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_cases(f"event_id % {len(_ALL_LABS) + 1}", (*_ALL_LABS, "Unknown"))).alias("lab"), F.floor("value").alias("value"))
    return rules.abnormal(raw, ontology.lab_limits(spark), "lab", "value").select("event_id", "lab", "abnormal")


_RISKS = "['single_source_critical_part' ,'lead_time_exceeded', 'quality_rejection_rate', 'geopolitical_risk_region', 'disruption_cascade']"


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name AS country, count(DISTINCT l_suppkey) OVER (PARTITION BY l_partkey) AS suppliers, l_quantity, l_discount, l_tax
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN suppliers = 1 THEN 'single_source_critical_part' END, CASE WHEN l_quantity > l_linenumber * 10 * 1.5 THEN 'lead_time_exceeded' END, CASE WHEN l_discount > 0.05 THEN 'quality_rejection_rate' END,
CASE WHEN country IN ('CHINA', 'RUSSIA') THEN 'geopolitical_risk_region' END, CASE WHEN suppliers = 1 AND l_tax > 0.04 THEN 'disruption_cascade' END], lambda x: x IS NOT NULL), ',') AS signals FROM f""")
def supply_risk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R10] All five supply risk rules."""
    from quern.operators import specialists

    lines = table(spark, sf_dir, "lineitem")
    sources = lines.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers"))
    home = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("country"))
    facts = lines.join(sources, "l_partkey").join(home, "l_suppkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_suppliers", "country", F.lit("critical").alias("criticality"), F.col("l_quantity").alias("actual_lead_days"), (F.col("l_linenumber") * 10).alias("expected_lead_days"),
        F.col("l_discount").alias("defect_rate"), F.array(F.lit("CHINA"), F.lit("RUSSIA")).alias("high_risk_regions"), (F.col("l_tax") > 0.04).alias("disrupted"),
    )
    found = specialists.supply_signals(facts)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform("signals", lambda s: s["rule_id"]), ",").alias("signals"))


# -- Streams and sinks --------------------------------------------------------------------------------


@query(f"WITH {_EV}, {_FIRED} SELECT lab_name, CAST(measured AS DOUBLE) AS value, unit, condition, reason, count(DISTINCT patient_id) AS patients FROM fired GROUP BY ALL ORDER BY patients DESC, lab_name, value, condition, reason LIMIT 15")
def lab_signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C15] Patients by test, value, unit, condition and reason."""
    labs = clinical_events(spark, sf_dir, "LAB_RESULT").select("patient_id", "payload.lab_name", F.col("payload.value").cast("double").alias("value"))
    units = ontology.lab_rules(spark).select("rule_id", "unit")
    fired = rules.threshold_signals(labs, ontology.lab_rules(spark), "lab_name", "value").join(F.broadcast(units), "rule_id")
    counted = fired.groupBy("lab_name", "value", "unit", "condition", "reason").agg(F.count_distinct("patient_id").alias("patients"))
    return counted.orderBy(F.desc("patients"), "lab_name", "value", "condition", "reason").limit(15)


_RAW = ("not json", '{"event_id": "1"}', '{"event_id": "2", "event_type": "X", "payload_json": "[1]"}', '{"event_id": "3", "event_type": "X"}', '{"event_id": "4", "event_type": "X", "payload_json": "{}"}', "{broken")
_PROBLEMS = ("not a JSON object", "no id or type", "payload is not an object", None, None, "no id or type")


@query(f"SELECT {_cases('event_id % 6', _PROBLEMS)} AS problem, count(*) AS n FROM events GROUP BY 1")
def envelope_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S03, S04, T10] Envelopes, some of them broken, with why they belong in quarantine."""
    texts = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("event_id") % 6 + 1).cast("int"))
    return envelopes.deserialised(table(spark, sf_dir, "events").select(texts.alias("raw"))).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T01, T02] Events replayed as a stream and counted by window, late ones up to the watermark."""
    root = new_folder(spark, "windows")
    events = ingest.replayed(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = ingest.windowed_counts(events, "ts", "event_type", "6 hours", "400 days")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/counts")
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/counts").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T11, S02] Each user and event type once within a watermark that spans the events."""
    root = new_folder(spark, "sightings")
    events = ingest.replayed(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.concat_ws("|", "user_id", "event_type").alias("key"))
    first = ingest.first_sightings(events, "key", "ts", "4000 days").select("user_id", "event_type")
    ingest.ingest(first, [lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/found/batch={n}")], f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/found").select("user_id", "event_type")


@query("SELECT e.event_id, c.c_name AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def stream_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T04, J01] Reference rows and events come in one stream; a batch's reference rows are visible to its events."""
    root = new_folder(spark, "enrichment")
    names = ingest.WriteLog(spark, f"{root}/names", ["user_id"], "seq", ["name"])
    people = table(spark, sf_dir, "customer").select(F.lit("reference").alias("route"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("event_id"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("route"), "user_id", F.lit(None).cast("string").alias("name"), "event_id")

    def sink(batch: DataFrame, batch_id: int) -> None:
        remember = lambda rows: names.apply(rows.withColumn("seq", F.lit(batch_id)), batch_id)
        enrich = lambda rows: rows.drop("name").join(names.read().select("user_id", "name"), "user_id", "left").write.mode("overwrite").parquet(f"{root}/found/batch={batch_id}")
        ingest.references_first(batch, remember, enrich)

    # People come with the first go, before or beside their events.
    rows = people.withColumn("at", F.lit(-1.0)).unionByName(events.withColumn("at", F.col("event_id").cast("double")))
    ingest.fed(spark, rows, "at", 3, lambda stream: ingest.ingest(stream, [sink], f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/found").select("event_id", "name")


@query("SELECT CAST(o_custkey AS VARCHAR) AS src, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def graph_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S16] A statement over edge tables as views."""
    from quern.plans import tools

    text = lambda of, src, dst: table(spark, sf_dir, of).select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
    views = {"placed": text("orders", "o_custkey", "o_orderkey"), "holds": text("lineitem", "l_orderkey", "l_partkey")}
    return tools.graph_sql(spark, views, "select p.src, count(*) as n from placed p join holds h on h.src = p.dst group by p.src")


@query("SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S14] Audit rows appended in two writes and read again."""
    path = new_folder(spark, "audit")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), "event_id")
    envelopes.audit(rows.where("event_id % 2 = 0"), path)
    envelopes.audit(rows.where("event_id % 2 = 1"), path)
    return spark.read.json(path).groupBy("tool").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1, 2")
def point_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S08, S09] Points of a collection, written in two batches; the last write of a point stays."""
    points = ingest.Collection(spark, new_folder(spark, "points"), dimension=2)
    key = F.concat_ws("|", "user_id", "event_type")
    rows = table(spark, sf_dir, "events").select(T.point_id(key).alias("point_id"), F.col("event_id").alias("arrival_seq"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.struct("user_id", "event_type", "event_id").alias("payload"))
    points.apply(rows.where("arrival_seq % 2 = 0"), 0)
    points.apply(rows.where("arrival_seq % 2 = 1"), 1)
    return points.read().select("payload.user_id", "payload.event_type", "payload.event_id")


# -- Records, scores and renderings -------------------------------------------------------------------


@query(f"""WITH {_EV} SELECT CAST(CAST('0x' || substr(md5(id), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS point_id, id AS event_id, type AS event_type, CASE WHEN type = 'CLINICAL_NOTE' THEN event_family END AS event_family, 'web' AS source_system, source_type, '0.1.0' AS ontology_version, k % 3 AS reference_hit_count, k % 3 > 0 AS enriched,
'vector_event_text' AS evidence_class, CASE WHEN k % 2 = 0 THEN 'high' END AS trust_level, words AS text, patient_id, CAST(384 AS INTEGER) AS dimension FROM ev""")
def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P15, P16, S08] Points of the vector table, payload fields side by side."""
    k = F.get_json_object("props", "$.k").cast("long")
    counts = table(spark, sf_dir, "events").select(F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_id"), (k % 3).alias("reference_hit_count"), F.when(k % 2 == 0, "high").alias("trust_level"))
    points = normalise.vector_record(clinical_events(spark, sf_dir).join(counts, "event_id"))
    shown = [F.col(f"payload.{c}").alias(c) for c in ("event_id", "event_type", "event_family", "source_system", "source_type", "ontology_version", "reference_hit_count", "enriched", "evidence_class", "trust_level", "text", "patient_id")]
    return points.select("point_id", *shown, F.size("embedding").alias("dimension"))


@query(r"""SELECT conv_id, turn, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR starts_with(text, 'LLM error:') THEN 0.0 WHEN length(text) > 50 AND length(text) < 5000 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS quality,
CAST(CASE WHEN regexp_matches(lower(text), 'not medical advice|consult|clinical judgment|demo data|synthetic|safety caveat|not a substitute|healthcare professional') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS caveat,
((turn > 0)::INT + (conv_id % 3 > 0)::INT) / 2 AS completeness, CAST(CASE WHEN turn % 4 = 0 THEN 0 ELSE len(list_filter([1, 2], lambda x: x <= turn % 4)) / 2 END AS DOUBLE) AS coverage FROM conversations""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P33, P31, Q13] Quality, caveat, completeness and coverage of answers."""
    from quern.plans import evaluation

    asked = table(spark, sf_dir, "conversations")
    expected = F.when(F.col("turn") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    found = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("turn") % 4).cast("int")))
    scores = {"quality": evaluation.quality_score(F.col("text")), "caveat": evaluation.caveat_score(F.col("text")), "completeness": evaluation.completeness_score(F.col("turn") > 0, F.col("conv_id") % 3 > 0), "coverage": evaluation.coverage_score(expected, found)}
    return asked.select("conv_id", "turn", *[c.alias(n) for n, c in scores.items()])


@query(f"""WITH {_EV} SELECT id AS event_id, CAST(100 + k AS VARCHAR) || '/' || CAST(60 + k % 30 AS VARCHAR) AS pressure, left('{{"heart_rate":' || heart_rate || ',"device_id":"' || device_id || '"}}', 25) AS cut FROM ev WHERE {_VITAL} AND k % 4 > 0""")
def vital_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P19, P40] Blood pressure as text, and a record as JSON cut to a length."""
    vitals = clinical_events(spark, sf_dir, "VITAL_SIGN").where("payload.systolic_bp is not null")
    return vitals.select("event_id", T.pressure(F.col("payload.systolic_bp"), F.col("payload.diastolic_bp")).alias("pressure"), T.json_cut(F.struct("payload.heart_rate", "payload.device_id"), 25).alias("cut"))


@query("SELECT vec_id, len(embedding[1:10]) + greatest(0, 10 - len(embedding)) AS short, CAST(100 AS BIGINT) AS long, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[1:10]]), 4) AS total FROM embeddings")
def fitted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P14] Vectors cut and padded."""
    from quern.functions import vectors as V

    points = table(spark, sf_dir, "embeddings").select("vec_id", V.fitted(F.col("embedding").cast("array<double>"), 10).alias("ten"), V.fitted(F.col("embedding").cast("array<double>"), 100).alias("hundred"))
    return points.select("vec_id", F.size("ten").cast("long").alias("short"), F.size("hundred").cast("long").alias("long"), F.round(F.aggregate("ten", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""SELECT sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint, count(*) AS n FROM events GROUP BY 1""")
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P28] SHA-256 of canonical JSON: sorted keys, no spaces."""
    return table(spark, sf_dir, "events").select(T.fingerprint(F.struct("user_id", "event_type"), ["user_id", "event_type"]).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("SELECT k, min(round) AS first_round, count(*) AS times FROM (SELECT user_id || '|' || event_type AS k, CASE WHEN value > 50 THEN 1 ELSE 2 END AS round FROM events) GROUP BY k")
def appended_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[U03, U07] Evidence of two rounds, appended; repeats count."""
    from quern.operators import upsert

    events = table(spark, sf_dir, "events").select("value", F.concat_ws("|", "user_id", "event_type").alias("k"))
    both = upsert.appended(events.where("value > 50"), events.where("value <= 50 or value is null"))
    return both.groupBy("k").agg(F.min("round").alias("first_round"), F.count("*").alias("times"))


# -- Context of patients and its projections ----------------------------------------------------------

#: Lists of a patient's context: fields, and the SQL of (owner, fields).
_CONTEXT = {
    "conditions": (("name",), f"SELECT patient_id AS owner, {{'name': diagnosis}} AS v FROM ev WHERE {_NOTE} AND diagnosis IS NOT NULL"),
    "codes": (("code", "condition"), f"SELECT patient_id AS owner, {{'code': icd10_code, 'condition': diagnosis}} AS v FROM ev WHERE {_NOTE} AND icd10_code IS NOT NULL AND diagnosis IS NOT NULL"),
    "signals": (("observation", "indicated"), "SELECT patient_id AS owner, {'observation': lab_name, 'indicated': condition} AS v FROM fired"),
    "medications": (("medication", "dose", "order_type"), f"SELECT patient_id AS owner, {{'medication': medication, 'dose': dose, 'order_type': order_type}} AS v FROM ev WHERE {_MED}"),
    "interactions": (("drug", "other", "risk", "severity"), f"SELECT patient_id AS owner, {{'drug': i.drug_a, 'other': i.drug_b, 'risk': i.risk, 'severity': i.severity}} AS v FROM active JOIN {_INTERACTIONS} ON i.drug_a = medication"),
    "contraindications": (("medication", "condition", "reason"), "SELECT patient_id AS owner, {'medication': medication, 'condition': condition, 'reason': reason} AS v FROM violated"),
    "adverse": (("symptom", "medication", "severity"), "SELECT patient_id AS owner, {'symptom': symptom, 'medication': drug, 'severity': severity_first} AS v FROM adverse"),
    "claims": (("claim", "status"), f"SELECT patient_id AS owner, {{'claim': claim_id, 'status': coalesce(status, '')}} AS v FROM ev WHERE {_CLAIM}"),
    "hits": (("kind", "event", "score"), "SELECT patient_id AS owner, {'kind': type, 'event': id, 'score': CAST(floor(CAST(k AS DOUBLE)) AS BIGINT)} AS v FROM ev WHERE k > 60"),
}
_CTES = {"signals": _FIRED, "interactions": _ACTIVE, "contraindications": _VIOLATED, "adverse": _ADVERSE}


#: What the lists of a context take from a payload.
_CONTEXT_FIELDS = ("diagnosis", "icd10_code", "symptom", "lab_name", "value", "medication", "dose", "order_type", "claim_id", "status")


def read_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical events with what a context takes from them and their ``score``, parsed once for all lists."""
    events = clinical(table(spark, sf_dir, "events"), score=True)
    return materialize(events.select("arrival_seq", "event_id", "event_ts", "event_type", "patient_id", "score", F.struct(*[f"payload.{f}" for f in _CONTEXT_FIELDS]).alias("payload")))


def _context_rows(spark: SparkSession, sf_dir: str, name: str, known: DataFrame) -> DataFrame:
    """(owner, list value) of one list, from the events ``known`` (``read_once``)."""
    of = lambda events, **fields: events.select(F.col("patient_id").alias("owner"), F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias(name))
    notes = lambda: clinical_events(spark, sf_dir, "CLINICAL_NOTE", known=known).where("payload.diagnosis is not null")
    if name == "conditions":
        return of(notes(), name="payload.diagnosis")
    if name == "codes":
        return of(notes().where("payload.icd10_code is not null"), code="payload.icd10_code", condition="payload.diagnosis")
    if name == "signals":
        return of(lab_signals(spark, sf_dir, known), observation="lab_name", indicated="condition")
    if name == "medications":
        return of(clinical_events(spark, sf_dir, "MEDICATION_ORDER", known=known), medication="payload.medication", dose="payload.dose", order_type="payload.order_type")
    if name == "interactions":
        live = _orders(spark, sf_dir, known).where(patterns.active(F.col("state"))).withColumnRenamed("owner", "patient_id")
        return of(live.join(ontology.interactions(spark), F.col("item") == F.col("drug_a")), drug="drug_a", other="drug_b", risk="risk", severity="severity")
    if name == "contraindications":
        return of(violations(spark, sf_dir, known), medication="medication", condition="condition", reason="reason")
    if name == "adverse":
        return of(adverse_events(spark, sf_dir, known), symptom="symptom", medication="medication", severity="severity")
    if name == "claims":
        return of(clinical_events(spark, sf_dir, "CLAIM_STATUS", known=known).withColumn("status", F.coalesce("payload.status", F.lit(""))), claim="payload.claim_id", status="status")
    return of(known.where("score > 60"), kind="event_type", event="event_id", score="score")


#: Projections of context and hits [C43-C54]: output, list, and which of it (SQL over ``x``; both engines read it).
PROJECTIONS = {
    "lab_and_interactions": {"infarctions": ("signals", "x.indicated = 'Acute Myocardial Infarction'"), "severe": ("interactions", "x.severity = 'high'"), "found": ("hits", "true")},
    "reactions": {"notes": ("hits", "x.kind = 'CLINICAL_NOTE'"), "events": ("adverse", "true"), "against": ("contraindications", "true")},
    "pharmacy_and_severity": {"orders": ("hits", "x.kind = 'MEDICATION_ORDER'"), "severe": ("interactions", "x.severity = 'high'")},
    "steroids_and_glucose": {"glucose": ("signals", "regexp_like(x.indicated, '(?i)hyperglycemia|diabetes')"), "risks": ("interactions", "regexp_like(x.risk, '(?i)hyperglycemia|glucose|hyperkal')"), "reasons": ("contraindications", "regexp_like(x.reason, '(?i)glucose|diabetes|toxicity')")},
    "claims_and_outcomes": {"told": ("hits", "x.kind = 'CLAIM_STATUS'"), "known": ("claims", "x.status <> ''")},
    "cohort_reactions": {"events": ("adverse", "true"), "against": ("contraindications", "true")},
    "coding_gap": {"notes": ("hits", "x.kind = 'CLINICAL_NOTE'"), "coded": ("codes", "true"), "every": ("conditions", "true")},
    "safety_review": {"orders": ("hits", "x.kind = 'MEDICATION_ORDER'"), "labs": ("hits", "x.kind = 'LAB_RESULT'"), "links": ("interactions", "true"), "against": ("contraindications", "true"), "signs": ("signals", "true"), "events": ("adverse", "true"), "drugs": ("medications", "true")},
    "depression_chain": {"orders": ("hits", "x.kind = 'MEDICATION_ORDER'"), "severe": ("interactions", "x.severity = 'high'"), "events": ("adverse", "true"), "every": ("conditions", "true")},
    "transfers_and_orders": {"notes": ("hits", "x.kind = 'CLINICAL_NOTE'"), "orders": ("hits", "x.kind = 'MEDICATION_ORDER'"), "drugs": ("medications", "true"), "every": ("conditions", "true")},
    "denials_and_codes": {"told": ("hits", "x.kind = 'CLAIM_STATUS'"), "notes": ("hits", "x.kind = 'CLINICAL_NOTE'"), "billed": ("claims", "true"), "coded": ("codes", "true")},
    "late_corrections": {"labs": ("hits", "x.kind = 'LAB_RESULT'"), "signs": ("signals", "true"), "drugs": ("medications", "true")},
}


def _projection_sql(outputs: dict[str, tuple[str, str]]) -> str:
    used = list(dict.fromkeys(n for n, _ in outputs.values()))
    ctes = ", ".join(dict.fromkeys([_EV, *[_CTES[n] for n in used if n in _CTES]]))
    lists = "\n".join(f"LEFT JOIN (SELECT owner, list_sort(list(DISTINCT v))[1:20] AS v FROM ({_CONTEXT[n][1]}) GROUP BY owner) {n} ON {n}.owner = patient_id" for n in used)
    shown = lambda n, keep: f"coalesce(array_to_string([concat_ws('|', {', '.join('x.' + f for f in _CONTEXT[n][0])}) FOR x IN {n}.v IF {keep.replace('regexp_like', 'regexp_matches')}], ','), '')"
    return f"WITH {ctes}\nSELECT patient_id, " + ", ".join(f"{shown(n, keep)} AS {out}" for out, (n, keep) in outputs.items()) + f" FROM (SELECT DISTINCT patient_id FROM ev)\n{lists}"


def projected(spark: SparkSession, sf_dir: str, outputs: dict[str, tuple[str, str]]) -> DataFrame:
    """Every patient's context, only the lists that are asked for, filtered and shown as text."""
    used = list(dict.fromkeys(n for n, _ in outputs.values()))
    known = read_once(spark, sf_dir)
    patients = known.select("patient_id").distinct()
    context = patterns.with_lists(patients, "patient_id", patterns.together(*[_context_rows(spark, sf_dir, n, known) for n in used]), "owner", dict.fromkeys(used, 20))
    text = lambda n, keep: F.expr(f"array_join(transform(filter({n}, x -> {keep}), x -> concat_ws('|', {', '.join(f'cast(x.{f} as string)' for f in _CONTEXT[n][0])})), ',')")
    return context.select("patient_id", *[text(n, keep).alias(out) for out, (n, keep) in outputs.items()])


def _register(name: str, place: int, outputs: dict[str, tuple[str, str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return projected(spark, sf_dir, outputs)

    run.__name__ = f"dual_path_{name}"
    run.__doc__ = f"[C{43 + place}]"
    query(_projection_sql(outputs))(run)


for _place, (_name, _outputs) in enumerate(PROJECTIONS.items()):
    _register(_name, _place, _outputs)
