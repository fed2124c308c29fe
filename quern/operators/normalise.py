"""Normalisation and rendering of typed events (payload as a struct), and their vector-store records.

Everything is a column expression over one event, so batch and stream share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V

#: How each payload field is written, by event type.
FIELDS = {
    "LAB_RESULT": {"lab_name": "title"},
    "MEDICATION_ORDER": {"medication": "title"},
    "CLINICAL_NOTE": {"symptom": "lower", "diagnosis": "plain", "icd10_code": "upper"},
    "CLAIM_STATUS": {"diagnosis_code": "upper", "procedure_code": "upper", "claim_type": "lower"},
}
#: How reference fields are written, by kind of record.
REFERENCE_FIELDS = {
    "patient": {"sex": "upper", "risk_tier": "lower"},
    "provider": {"specialty": "plain"},
    "device": {"device_type": "lower"},
    "medication": {"drug_class": "plain", "safety_tier": "lower"},
    "payer": {"plan_type": "plain", "network_tier": "lower"},
}
_STYLES = {"title": T.title, "plain": T.squeeze, "lower": lambda c: F.lower(T.squeeze(c)), "upper": lambda c: F.upper(T.squeeze(c))}


def _restyled(record: Column, fields: dict[str, str], present: list[str]) -> Column:
    """``record`` with fields rewritten; a blank field keeps what it was."""
    for name, style in fields.items():
        if name in present:
            record = record.withField(name, F.coalesce(_STYLES[style](record[name]), record[name]))
    return record


def normalised(events: DataFrame, event_type: str) -> DataFrame:
    """[P04, P05] Events of one type with source type and payload fields in their standard spelling."""
    present = events.schema["payload"].dataType.fieldNames()
    payload = _restyled(F.col("payload"), FIELDS.get(event_type, {}), present)
    return events.withColumns({"payload": payload, "source_type": F.coalesce(F.upper(T.squeeze(F.col("source_type"))), F.col("source_type"))})


def normalised_reference(events: DataFrame, kinds: list[str]) -> DataFrame:
    """[P06] Reference structs (columns named by kind) in their standard spelling; a missing one stays null."""
    out = {}
    for kind in kinds:
        present = events.schema[kind].dataType.fieldNames()
        out[kind] = F.when(F.col(kind).isNotNull(), _restyled(F.col(kind), REFERENCE_FIELDS[kind], present))
    return events.withColumns(out)


def code_mapping(system: str, code: Column, display: Column) -> Column:
    """[P07] struct<standard_system,standard_code,display> of a code that is its own standard; null without one."""
    return F.when(code.isNotNull(), F.struct(F.lit(system).alias("standard_system"), code.alias("standard_code"), display.alias("display")))


#: The sentence of each event type, its JSON fields in braces.
CLINICAL_SENTENCES = {
    "CLINICAL_NOTE": "Patient {{patient_id}} clinical note from {{source_system}}. Diagnosis {diagnosis} ICD10 {icd10_code}. Symptom {symptom}. Note: {note}",
    "LAB_RESULT": "Patient {{patient_id}} lab result. {lab_name} equals {value} {unit}. Panel {lab_panel}. Specimen {specimen_type}. Abnormal: {abnormal}",
    "VITAL_SIGN": "Patient {{patient_id}} device telemetry from {{source_system}}. Heart rate {heart_rate}, SpO2 {spo2}, BP {systolic_bp}/{diastolic_bp}, temp {temperature_c} C, RR {respiratory_rate}.",
    "MEDICATION_ORDER": "Patient {{patient_id}} medication order. Medication {medication} drug class {drug_class} dose {dose} route {route} frequency {frequency} order type {order_type}.",
    "CLAIM_STATUS": "Patient {{patient_id}} claim event. Payer {payer} procedure {procedure_code} {procedure_description} diagnosis {diagnosis_code} billed {billed_amount} status {status}.",
}
SUPPLY_SENTENCES = {
    "PURCHASE_ORDER": "Purchase order {po_number} from supplier {supplier_id} for part {part_name|part_id} qty {quantity} status {status}.",
    "SHIPMENT_UPDATE": "Shipment {shipment_id} via {transport_mode} from {origin_facility} to {destination_facility} status {status} lead {actual_lead_days}d (expected {expected_lead_days}d).",
    "QUALITY_RESULT": "Quality inspection {inspection_id} for part {part_id} result {result} defect_rate {defect_rate}.",
    "DISRUPTION_ALERT": "Disruption {disruption_type} at {facility_id} severity {severity} region {region}. {description}",
    "INVENTORY_LEVEL": "Inventory at {facility_id} part {part_id} on_hand {on_hand_qty} {below_reorder?BELOW REORDER:ok} days_of_supply {days_of_supply}.",
}
#: What is said of reference data, by kind of record.
REFERENCE_SENTENCES = {
    "patient": ("Patient profile age %s, sex %s, risk %s.", ("age", "sex", "risk_tier")),
    "provider": ("Provider %s specialty %s.", ("name", "specialty")),
    "device": ("Device model %s vendor %s.", ("model", "vendor")),
    "medication": ("Medication class %s safety tier %s.", ("drug_class", "safety_tier")),
    "payer": ("Payer plan %s region %s.", ("plan_type", "region")),
}


#: A value that may not read as it is written once the whole object is read as text: a float, a list or an object.
_RESTYLED = r"^(?:[\[{]|-?[0-9]+[.eE])"


def _filled(pattern: str, get) -> Column:
    """``pattern`` filled with what ``get`` gives for a field."""
    import re

    parts = []
    for token in re.split(r"(\{\{?[^{}]*\}?\})", pattern):
        name = token.strip("{}")
        if token.startswith("{{"):
            parts.append(T.shown(F.col(name)))
        elif token.startswith("{") and "?" in name:
            flag, yes, no = re.split(r"[?:]", name)
            parts.append(F.when(get(flag) == "true", yes).otherwise(no))
        elif token.startswith("{") and "|" in name:
            parts.append(T.shown(F.coalesce(*map(get, name.split("|")))))
        elif token.startswith("{"):
            value = get(name)
            parts.append(F.when(value.isin("true", "false"), F.initcap(value)).otherwise(T.shown(value)))
        elif token:
            parts.append(F.lit(token))
    return F.concat(*parts)


def _chosen(event_type: Column, sentences: dict[str, str], get, other: Column) -> Column:
    """The sentence of the event's type, or ``other``."""
    out = F
    for kind, pattern in sentences.items():
        out = out.when(event_type == kind, _filled(pattern, get))
    return out.otherwise(other)


def sentence(pattern: str, payload: Column) -> Column:
    """[P08, P10] ``pattern`` filled from JSON text: {field}, {first|else}, {flag?yes:no}, {{event column}}.

    Numbers keep the form they have in the JSON; booleans read True and False; a null reads None.
    """
    return _filled(pattern, lambda f: F.get_json_object(payload, f"$.{f}"))


def rendered(event_type: Column, payload: Column, sentences: dict[str, str], whole: Column, limit: int | None = None) -> Column:
    """[P08, P10] The sentence of the event's type; other types show ``whole``, cut to ``limit``.

    An object is read once for all of its fields; what is no object is read field by field.
    """
    other = F.left(whole, F.lit(limit)) if limit else whole
    single = lambda f: F.get_json_object(payload, f"$.{f}")

    def of_object(fields: Column) -> Column:
        def get(f: str) -> Column:
            value = F.try_element_at(fields, F.lit(f))
            return F.when(value.rlike(_RESTYLED), single(f)).otherwise(value)

        return F.when(fields.isNull(), _chosen(event_type, sentences, single, other)).otherwise(_chosen(event_type, sentences, get, other))

    # Half a character that is written as an escape, and numbers that are none, are read differently: field by field.
    whole_object = F.when(~F.contains(payload, F.lit("\\u")), payload)
    return F.transform(F.array(F.from_json(whole_object, "map<string,string>", {"allowNonNumericNumbers": "false"})), of_object)[0]


def reference_summary(kinds: list[str]) -> Column:
    """[P09] Sentences about the reference structs that are there; those that would say None are left out."""
    said = []
    for kind in kinds:
        pattern, fields = REFERENCE_SENTENCES[kind]
        said.append(F.when(F.col(kind).isNotNull(), F.format_string(pattern, *[T.shown(F.col(f"{kind}.{f}")) for f in fields])))
    return T.sentences(*said)


#: Payload fields of a point that are taken from the event.
POINT_FIELDS = ("event_id", "event_ts", "event_type", "event_family", "source_system", "source_type", "ontology_version", "trust_level", "phi_class", "retention_class")


def vector_record(events: DataFrame, text: str = "text", payload: str = "payload", ids: dict[str, str] | None = None) -> DataFrame:
    """[P15, P16, S08] (point_id, arrival_seq, embedding, payload) of enriched events, for a keyed vector table.

    The payload has POINT_FIELDS (null where the events lack one), ``enriched`` and ``reference_hit_count``
    (by default false and 0), the evidence class, the text, the event's own payload, and a field for each of
    ``ids`` (name: event column).
    """
    of = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    family = F.col(f"{payload}.event_family") if "event_family" not in events.columns and payload in events.columns and "event_family" in events.schema[payload].dataType.fieldNames() else of("event_family")
    fields = [(family if c == "event_family" else of(c)).alias(c) for c in POINT_FIELDS]
    hits = F.coalesce(F.col("reference_hit_count"), F.lit(0)) if "reference_hit_count" in events.columns else F.lit(0)
    enriched = F.coalesce(F.col("enriched"), F.lit(False)) if "enriched" in events.columns else hits > 0
    own = [F.col(payload).alias("payload")] if payload in events.columns else []
    named = [F.col(column).alias(name) for name, column in (ids or {"patient_id": "patient_id"}).items()]
    record = F.struct(*fields, enriched.alias("enriched"), hits.alias("reference_hit_count"), F.lit("vector_event_text").alias("evidence_class"), F.col(text).alias("text"), *own, *named)
    order = F.col("arrival_seq") if "arrival_seq" in events.columns else F.lit(0).cast("long")
    return events.select(T.point_id(F.col("event_id")).alias("point_id"), order.alias("arrival_seq"), V.embedding(F.col(text)).alias("embedding"), record.alias("payload"))


#: Where the mapping of a payload field to a standard terminology goes, and in which vocabulary it is looked up.
SEMANTICS = {
    "LAB_RESULT": {"observation": ("lab_name", "labs")},
    "MEDICATION_ORDER": {"medication": ("medication", "medications")},
    "CLINICAL_NOTE": {"symptom": ("symptom", "adverse_reactions"), "condition": ("diagnosis", "conditions")},
}
#: Vocabularies of reference fields: (kind of record, field): family.
REFERENCE_SEMANTICS = {
    ("patient", "sex"): "patient_sex",
    ("patient", "risk_tier"): "patient_risk_tiers",
    ("provider", "specialty"): "provider_specialties",
    ("device", "device_type"): "device_types",
    ("medication", "drug_class"): "medication_drug_classes",
    ("medication", "safety_tier"): "medication_safety_tiers",
    ("payer", "plan_type"): "payer_plan_types",
    ("payer", "network_tier"): "payer_network_tiers",
}


def mapped(events: DataFrame, vocabulary: DataFrame, code: Column, family: str, name: str) -> DataFrame:
    """[J03, P06] ``events`` with ``name``: local code, system, code and display of a term; null on a miss.

    The join is the optimizer's choice: terminologies may be large.
    """
    found = F.struct("local_code", "standard_system", "standard_code", "display") if "standard_code" in vocabulary.columns else F.struct("local_code", "standard_system", F.col("local_code").alias("standard_code"), "display")
    terms = vocabulary.where(F.col("family") == family).select(F.col("lookup").alias("__lookup"), found.alias(name))
    return events.join(terms, T.folded(code) == F.col("__lookup"), "left").drop("__lookup")


def semantics(events: DataFrame, vocabulary: DataFrame, event_type: str) -> DataFrame:
    """[P05, P07] Events of one type with a column ``<entity>_mapping`` for what the type maps; claims map to themselves."""
    out = normalised(events, event_type)
    for entity, (field, family) in SEMANTICS.get(event_type, {}).items():
        out = mapped(out, vocabulary, F.col(f"payload.{field}"), family, f"{entity}_mapping")
    if event_type == "CLAIM_STATUS":
        out = out.withColumns({
            "diagnosis_mapping": code_mapping("ICD10", F.col("payload.diagnosis_code"), F.col("payload.diagnosis_code")),
            "procedure_mapping": code_mapping("CPT", F.col("payload.procedure_code"), F.col("payload.procedure_description")),
        })
    return out


def reference_semantics(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """[P06] Events with ``payload.reference_data`` in standard spelling and a column ``<kind>_<field>_mapping`` for each of the eight."""
    kinds = list(REFERENCE_FIELDS)
    raw = events.select("*", *[F.col(f"payload.reference_data.{k}").alias(k) for k in kinds])
    out = normalised_reference(raw, kinds)
    for (kind, field), family in REFERENCE_SEMANTICS.items():
        out = mapped(out, vocabulary, F.col(f"{kind}.{field}"), family, f"{kind}_{field}_mapping")
    return out
