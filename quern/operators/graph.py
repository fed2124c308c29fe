"""Property graph from events: what each event type writes, and the state that the writes leave.

A write program is data: nodes and edges with their keys and properties as SQL expressions over the event
and its payload.  ``writes`` is one projection and one explode, however long the program; ``folded`` is
one aggregation over the properties and one over the identities.  Both serve batch and ``foreachBatch``.

Properties keep their type: they are VARIANT values, read by ``variant_get(props['age'], '$', 'int')``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a property is written: every time (null removes it); only if not null; by the write that makes the
#: node or edge; by every later write.
SET, KEEP, ONCE, AGAIN = "set", "keep", "once", "again"

#: What a node (empty kind, key in ``src``) or an edge is told apart by; ``tag`` is a property that an edge is merged on.
IDENTITY = ("kind", "src_label", "src", "dst_label", "dst", "tag")
_PROPS = "array<struct<name:string,value:variant,policy:string>>"
_ROWS = f"array<struct<kind:string,src_label:string,src:string,dst_label:string,dst:string,tag:string,at:int,matched:boolean,writes:{_PROPS}>>"


@dataclass(frozen=True)
class Node:
    """A node with its key and properties (name: SQL expression) by policy.

    ``each`` is an array: the node is written for every element, which is called ``it``.
    """

    label: str
    key: str
    props: dict[str, str] = field(default_factory=dict)
    keep: dict[str, str] = field(default_factory=dict)
    once: dict[str, str] = field(default_factory=dict)
    again: dict[str, str] = field(default_factory=dict)
    when: str = "true"
    each: str = ""


@dataclass(frozen=True)
class Edge:
    """An edge between two nodes (label, key expression), which it makes if they are not there.

    ``matched``: the target is not made; the edge is only there if something else has made it before.
    """

    kind: str
    src: tuple[str, str]
    dst: tuple[str, str]
    props: dict[str, str] = field(default_factory=dict)
    keep: dict[str, str] = field(default_factory=dict)
    once: dict[str, str] = field(default_factory=dict)
    again: dict[str, str] = field(default_factory=dict)
    when: str = "true"
    each: str = ""
    tag: str = "''"
    matched: bool = False


def _p(*names: str) -> dict[str, str]:
    return {n: f"payload.{n}" for n in names}


def _standard(at: str, prefix: str = "", fields: tuple[str, ...] = ("standard_system", "standard_code", "display")) -> dict[str, str]:
    """Properties of a mapping to a standard terminology."""
    return {f"{prefix}{f}": f"{at}.{f}" for f in fields}


_PATIENT, _EVENT = ("Patient", "patient_id"), ("ClinicalEvent", "event_id")
_TS = "try_cast(event_ts as timestamp)"
_FROM = {"provenance_source_type": "source_type"}
_NUMBER = "coalesce(cast(try_cast(payload.value as double) as variant), cast(payload.value as variant))"
_ALLERGY = "payload.event_family = 'ALLERGY_INTOLERANCE' and payload.allergen <> ''"
_ALLERGIC = ("AdverseEvent", "concat('ae-allergy-', event_id)")
#: Substances whose allergies are tied to medications.
ALLERGENS = ("Penicillin", "Aspirin", "ACE inhibitors", "Morphine", "Sulfa drugs", "Amoxicillin")

#: What every clinical event writes [M01].
CLINICAL_BASE = (
    Node("Patient", "patient_id"),
    Node("SourceSystem", "source_system", {"type": "source_type"}),
    Node("ClinicalEvent", "event_id", {"event_type": "event_type", "event_ts": _TS, "text": "text", "schema_version": "schema_version", "ontology_version": "ontology_version"} | _FROM),
    Edge("ABOUT_PATIENT", _EVENT, _PATIENT),
    Edge("FROM_SOURCE", _EVENT, ("SourceSystem", "source_system")),
    Edge("DURING_ENCOUNTER", _EVENT, ("Encounter", "encounter_id")),
    Edge("SEEN_BY", ("Encounter", "encounter_id"), ("Provider", "provider_id")),
)

_REF, _MEANS = "payload.reference_data", "payload.semantic.reference_context"


def _reference(kind: str, label: str, key: str, props: tuple[str, ...], mapped: tuple[str, ...], relation: str, source: bool) -> tuple:
    """The node of a kind of reference record, and the edge from the patient to it."""
    there = f"{_REF}.{kind} is not null"
    keep = {p: f"{_REF}.{kind}.{p}" for p in props} | (_FROM if source else {})
    for m in mapped:
        keep |= _standard(f"{_MEANS}.{kind}.{m}_mapping", f"{m}_")
    node = Node(label, key, keep=keep, when=there)
    return (node, Edge(relation, _PATIENT, (label, key), when=there)) if relation else (node,)


#: What the reference data of an event writes [M02].
CLINICAL_REFERENCE = (
    *_reference("patient", "Patient", "patient_id", ("name", "sex", "age", "risk_tier"), ("sex", "risk_tier"), "", False),
    *_reference("provider", "Provider", "provider_id", ("name", "specialty", "organization", "npi"), ("specialty",), "MANAGED_BY", True),
    *_reference("device", "Device", "payload.device_id", ("model", "vendor", "device_type"), ("device_type",), "REGISTERED_DEVICE", True),
    *_reference("medication", "Medication", "payload.medication", ("drug_class", "safety_tier"), ("drug_class", "safety_tier"), "KNOWN_MEDICATION", False),
    *_reference("payer", "Payer", "payload.payer", ("plan_type", "region", "network_tier"), ("plan_type", "network_tier"), "COVERED_BY", True),
)

_CONDITION, _SYMPTOM, _DRUG = ("Condition", "payload.diagnosis"), ("Symptom", "payload.symptom"), ("Medication", "payload.medication")
_CLAIM, _PROCEDURE = ("Claim", "payload.claim_id"), ("Procedure", "payload.procedure_code")
#: What each clinical event type writes besides [M03-M08, M10].  ``signals`` and ``outcomes`` are the rules that fired.
CLINICAL = {
    "CLINICAL_NOTE": (
        Node(*_CONDITION, keep=_standard("payload.semantic.condition.mapping") | _FROM, once={"first_seen_ts": _TS}, again={"last_seen_ts": _TS}),
        Node(*_SYMPTOM, keep=_standard("payload.semantic.symptom.mapping") | _FROM),
        Edge("HAS_CONDITION", _PATIENT, _CONDITION, once={"onset_ts": _TS}),
        Edge("HAS_SYMPTOM", _PATIENT, _SYMPTOM),
        Edge("DOCUMENTS", _EVENT, _CONDITION),
        Edge("DOCUMENTS", _EVENT, _SYMPTOM),
        Node("ICD10Code", "payload.icd10_code", {"standard_system": "'ICD10'"}, {"display": "payload.icd10_code"}),
        Edge("CODED_AS", _CONDITION, ("ICD10Code", "payload.icd10_code")),
        Node(*_ALLERGIC, once={"symptom_name": "payload.symptom", "detected_ts": _TS, "source_event_id": "event_id", "severity": "coalesce(payload.reaction_severity, 'unknown')", "meddra_term": "payload.diagnosis", "allergen": "payload.allergen", "event_family": "'ALLERGY_INTOLERANCE'"}, when=_ALLERGY),
        Edge("REPORTED_ADVERSE_REACTION", _PATIENT, _ALLERGIC, when=_ALLERGY),
        Edge("TRIGGERED_BY_EVENT", _ALLERGIC, _EVENT, when=_ALLERGY),
        Edge("ASSOCIATED_WITH_MEDICATION", _ALLERGIC, ("Medication", "payload.allergen"), when=f"{_ALLERGY} and payload.allergen in {ALLERGENS}", matched=True),
    ),
    "LAB_RESULT": (
        Node("Observation", "event_id", {"name": "payload.lab_name", "value": _NUMBER, "abnormal": "coalesce(payload.abnormal, false)", "event_ts": _TS} | _p("unit", "lab_panel", "specimen_type"), _standard("payload.semantic.observation.mapping") | _FROM),
        Edge("HAS_OBSERVATION", _PATIENT, ("Observation", "event_id")),
        Edge("DOCUMENTS", _EVENT, ("Observation", "event_id")),
        Edge("MAY_INDICATE", ("Observation", "event_id"), ("Condition", "it.condition"), {"rule_id": "it.rule_id", "reason": "it.reason"}, each="signals", tag="it.reason"),
    ),
    "VITAL_SIGN": (
        Node("Device", "payload.device_id", keep=_p("device_type")),
        Node("DeviceReading", "event_id", {"event_ts": _TS} | _p("heart_rate", "spo2", "systolic_bp", "diastolic_bp", "temperature_c", "respiratory_rate", "glucose_mg_dl", "alert")),
        Edge("HAS_DEVICE_READING", _PATIENT, ("DeviceReading", "event_id")),
        Edge("MEASURED_BY", ("DeviceReading", "event_id"), ("Device", "payload.device_id")),
        Edge("DOCUMENTS", _EVENT, ("DeviceReading", "event_id")),
    ),
    "MEDICATION_ORDER": (
        Node(*_DRUG, keep=_p("drug_class") | _standard("payload.semantic.medication.mapping") | _FROM),
        Node("MedicationOrder", "event_id", {"event_ts": _TS} | _p("dose", "route", "frequency", "order_type", "days_supply")),
        Edge("ORDERS_MEDICATION", ("MedicationOrder", "event_id"), _DRUG),
        Edge("HAS_MEDICATION_ORDER", _PATIENT, ("MedicationOrder", "event_id")),
        Edge("DOCUMENTS", _EVENT, ("MedicationOrder", "event_id")),
    ),
    "CLAIM_STATUS": (
        Node(*_CLAIM, {"event_ts": _TS} | _p("status", "claim_type", "diagnosis_code", "billed_amount", "allowed_amount", "service_date"), _standard("payload.semantic.claim.diagnosis_mapping", "diagnosis_", ("standard_system",)) | _standard("payload.semantic.claim.procedure_mapping", "procedure_", ("standard_system",)) | _FROM),
        Edge("HAS_CLAIM", _PATIENT, _CLAIM),
        Edge("DOCUMENTS", _EVENT, _CLAIM),
        Node(*_PROCEDURE, keep=_standard("payload.semantic.claim.procedure_mapping", "", ("standard_system", "display")) | _FROM, once={"description": "payload.procedure_description"}),
        Edge("FOR_PROCEDURE", _CLAIM, _PROCEDURE),
        Edge("SUBMITTED_TO", _CLAIM, ("Payer", "payload.payer")),
        Edge("RESULTED_IN", _CLAIM, ("AdverseOutcome", "it.outcome"), {"rule_id": "it.rule_id"}, each="outcomes"),
    ),
}
_REACTION = ("AdverseEvent", "concat('ae-', note_id)")
#: What a known reaction to an ordered drug writes [M09], over the rows of ``rules.adverse_matches``.
ADVERSE = (
    Node(*_REACTION, once={"symptom_name": "symptom", "detected_ts": _TS, "source_event_id": "note_id", "severity": "severity", "meddra_term": "meddra_term"}),
    Edge("REPORTED_ADVERSE_REACTION", _PATIENT, _REACTION),
    Edge("ASSOCIATED_WITH_MEDICATION", _REACTION, ("Medication", "medication")),
    Edge("TRIGGERED_BY_EVENT", _REACTION, ("ClinicalEvent", "note_id")),
)

_SUPPLY_EVENT = ("SupplyChainEvent", "event_id")
#: What every supply-chain event writes [M11].
SUPPLY_BASE = (
    Node("SourceSystem", "source_system", {"type": "source_type"}),
    Node("SupplyChainEvent", "event_id", {"event_type": "event_type", "event_ts": _TS, "text": "text", "schema_version": "schema_version"}),
    Edge("FROM_SOURCE", _SUPPLY_EVENT, ("SourceSystem", "source_system")),
    Edge("ABOUT_PART", _SUPPLY_EVENT, ("Part", "entity_id")),
    Edge("AT_FACILITY", _SUPPLY_EVENT, ("Facility", "facility_id")),
    Edge("INVOLVES_SUPPLIER", _SUPPLY_EVENT, ("Supplier", "supplier_id")),
)
_SUPPLIER, _PART, _FACILITY = ("Supplier", "payload.supplier_id"), ("Part", "payload.part_id"), ("Facility", "payload.facility_id")
_DESTINATION = ("Facility", "payload.destination_facility")
_ORDER, _SHIPMENT = ("PurchaseOrder", "payload.po_number"), ("Shipment", "payload.shipment_id")
_INSPECTION, _DISRUPTION = ("QualityInspection", "payload.inspection_id"), ("DisruptionEvent", "payload.disruption_id")
#: What each supply-chain event type writes besides [M12-M16].
SUPPLY = {
    "PURCHASE_ORDER": (
        Node(*_SUPPLIER),
        Node(*_PART, keep={"name": "payload.part_name", "commodity_category": "payload.commodity_category"}),
        Node(*_DESTINATION),
        Node(*_ORDER, {"expected_delivery": "payload.expected_delivery_date", "event_ts": _TS} | _p("quantity", "unit_price", "total_value", "currency", "incoterm", "status")),
        Edge("ORDERED_FROM", _ORDER, _SUPPLIER),
        Edge("ORDERS_PART", _ORDER, _PART),
        Edge("DELIVERS_TO", _ORDER, _DESTINATION),
        Edge("SUPPLIES", _SUPPLIER, _PART),
    ),
    "SHIPMENT_UPDATE": (
        Node(*_SHIPMENT, {"event_ts": _TS} | _p("transport_mode", "carrier", "container_id", "status", "expected_lead_days", "actual_lead_days", "quantity", "weight_kg", "customs_cleared")),
        Edge("SHIPPED_FROM", _SHIPMENT, ("Facility", "payload.origin_facility")),
        Edge("SHIPPED_TO", _SHIPMENT, _DESTINATION),
        Edge("CONTAINS_PART", _SHIPMENT, _PART),
        Edge("FROM_SUPPLIER", _SHIPMENT, _SUPPLIER),
    ),
    "QUALITY_RESULT": (
        Node(*_INSPECTION, {"event_ts": _TS} | _p("inspection_type", "sample_size", "defects_found", "defect_rate", "result", "corrective_action_required")),
        Edge("INSPECTED_PART", _INSPECTION, _PART),
        Edge("INSPECTED_AT", _INSPECTION, _FACILITY),
        Edge("SUPPLIED_BY", _INSPECTION, _SUPPLIER),
    ),
    "DISRUPTION_ALERT": (
        Node(*_FACILITY, keep=_p("region", "country")),
        Node(*_DISRUPTION, {"event_ts": _TS} | _p("disruption_type", "severity", "region", "country", "estimated_duration_days", "description", "mitigation_status")),
        Edge("DISRUPTED_BY", _FACILITY, _DISRUPTION),
        Edge("AFFECTS_PART", _DISRUPTION, ("Part", "it"), each="payload.affected_parts"),
    ),
    "INVENTORY_LEVEL": (
        Edge("HOLDS_INVENTORY", _FACILITY, _PART, {"updated_ts": _TS} | _p("on_hand_qty", "allocated_qty", "in_transit_qty", "reorder_point", "below_reorder", "days_of_supply")),
    ),
}
#: What supply-chain reference records write, by kind [M17]; null values never replace known ones.
SUPPLY_REFERENCE = {
    "SUPPLIER": (Node(*_SUPPLIER, keep=_p("name", "country", "region", "tier", "risk_score", "iso_certified", "geopolitical_risk")),),
    "PART": (Node(*_PART, keep={"name": "payload.part_name"} | _p("commodity_category", "criticality", "lead_time_days", "supplier_count", "single_source")),),
    "FACILITY": (Node(*_FACILITY, keep=_p("name", "facility_type", "country", "region", "capacity_utilization", "operational_status")),),
}

#: What programs may refer to; columns that the events lack are null.
_OPTIONAL = {
    "text": "string",
    "ontology_version": "string",
    "signals": "array<struct<condition:string,reason:string,rule_id:string>>",
    "outcomes": "array<struct<outcome:string,rule_id:string>>",
}


def program_of(base: tuple, by_type: dict[str, tuple], kind: str = "event_type") -> tuple:
    """``base``, then each type's items for the events of that type."""
    typed = [replace(item, when=f"{kind} = '{name}' and ({item.when})") for name, items in by_type.items() for item in items]
    return (*base, *typed)


def _row(kind: str, src: tuple[str, str], dst: tuple[str, str], tag: str, at: int, matched: bool, props: str) -> str:
    fields = {"kind": f"'{kind}'", "src_label": f"'{src[0]}'", "src": f"cast({src[1]} as string)", "dst_label": f"'{dst[0]}'", "dst": f"cast({dst[1]} as string)", "tag": f"cast({tag} as string)", "at": str(at), "matched": str(matched).lower(), "writes": props}
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def _covered(end: tuple[str, str], edge: Edge, before: tuple) -> bool:
    """Whether an item before the edge writes this end of it, wherever the edge is written: then the edge adds nothing."""
    return any(isinstance(n, Node) and (n.label, n.key) == end and not n.each and n.when in ("true", edge.when) for n in before)


def _sort(kind: str, src: tuple[str, str], dst: tuple[str, str]) -> tuple[str, str, str]:
    """What an identity is but for its keys."""
    return kind, src[0], dst[0]


_NOTHING = ("", "''")


def _made(item: Node | Edge, before: tuple = ()) -> list[tuple]:
    """(kind, src, dst, tag) of what an item of a program writes, after the items ``before`` it; the last one has the properties."""
    if isinstance(item, Node):
        return [("", (item.label, item.key), _NOTHING, "''")]
    ends = [end for end in ((item.src,) if item.matched else (item.src, item.dst)) if not _covered(end, item, before)]
    return [*[("", end, _NOTHING, "''") for end in ends], (item.kind, item.src, item.dst, item.tag)]


def _there(item: Node | Edge) -> str:
    keys = f"({item.key}) is not null" if isinstance(item, Node) else f"({item.src[1]}) is not null and ({item.dst[1]}) is not null"
    return f"coalesce(({item.when}) and {keys}, false)"


def _rows(item: Node | Edge, at: int, before: tuple = (), but: frozenset = frozenset()) -> str:
    """SQL of the array of rows that an item of a program writes, after the items ``before`` it, but for some sorts of identities."""
    policies = ((SET, item.props), (KEEP, item.keep), (ONCE, item.once), (AGAIN, item.again))
    entries = [f"named_struct('name', '{n}', 'value', cast({e} as variant), 'policy', '{policy}')" for policy, props in policies for n, e in props.items()]
    none = f"cast(array() as {_PROPS})"
    props = f"array({', '.join(entries)})" if entries else none
    *ends, last = _made(item, before)
    made = [_row(*end, at, False, none) for end in ends if _sort(*end[:3]) not in but]
    if _sort(*last[:3]) not in but:
        made.append(_row(*last, at, isinstance(item, Edge) and item.matched, props))
    rows = f"if({_there(item)}, cast(array({', '.join(made)}) as {_ROWS}), cast(array() as {_ROWS}))" if made else f"cast(array() as {_ROWS})"
    return f"coalesce(flatten(transform({item.each}, it -> {rows})), cast(array() as {_ROWS}))" if item.each else rows


def writes(events: DataFrame, program: tuple, order: str = "arrival_seq", first: int = 0) -> DataFrame:
    """(kind, src_label, src, dst_label, dst, tag, at, matched, writes, seq): what each event writes.

    ``first`` numbers the program's first item: of programs that are written one after the other, the later ones
    begin beyond the earlier.

    A node with a null key is left out, and so is an edge with a null end; the rest of the event is
    written all the same.  An edge also writes its end nodes, but for those that the program has written before it
    anyway.
    """
    return writes_of(events, {first: program}, order)


def writes_of(events: DataFrame, programs: dict[int, tuple], order: str = "arrival_seq") -> DataFrame:
    """``writes`` of several programs at once, each with the number of its first item: the events are read once."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in events.columns}
    made = F.expr(f"concat({', '.join(_rows(item, first + at, program[:at]) for first, program in programs.items() for at, item in enumerate(program))})")
    return events.withColumns(missing).select(F.col(order).cast("long").alias("seq"), F.explode(made).alias("w")).select("seq", "w.*")


def keys_written(events: DataFrame, program: tuple, order: str = "arrival_seq") -> DataFrame:
    """(label, key, seq): the nodes that each event writes, once each, without their properties."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in events.columns}
    none = "cast(array() as array<struct<label:string,key:string>>)"
    entries = []
    for item in program:
        if isinstance(item, Node):
            ends, there = [(item.label, item.key)], f"({item.key}) is not null"
        else:
            ends, there = [item.src] if item.matched else [item.src, item.dst], f"({item.src[1]}) is not null and ({item.dst[1]}) is not null"
        made = ", ".join(f"named_struct('label', '{label}', 'key', cast({key} as string))" for label, key in ends)
        rows = f"if(coalesce(({item.when}) and {there}, false), cast(array({made}) as array<struct<label:string,key:string>>), {none})"
        entries.append(f"coalesce(flatten(transform({item.each}, it -> {rows})), {none})" if item.each else rows)
    nodes = F.expr(f"array_distinct(concat({', '.join(dict.fromkeys(entries))}))")
    return events.withColumns(missing).select(F.col(order).cast("long").alias("seq"), F.explode(nodes).alias("n")).select("n.*", "seq")


def key_counts(written: DataFrame) -> DataFrame:
    """[M18] (label, keys, merged, broken) of ``keys_written``: keys, those that several events write, those that are there twice.

    A row for each key and task is shuffled, once; looking for what is there twice needs no shuffle of its own.
    """
    nodes = written.groupBy("label", "key").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    there = nodes.groupBy("label", "key").agg(F.count("*").alias("rows"), F.max(F.col("first") < F.col("last")).alias("several"))
    return there.groupBy("label").agg(F.count("*").alias("keys"), F.count_if("several").alias("merged"), F.count_if(F.col("rows") > 1).alias("broken"))


_NAMED = [*IDENTITY, "name"]


def _keyed(*columns: str) -> list:
    """``columns`` to group by, after a hash of them: sorts compare one number where they would compare six texts."""
    return [F.xxhash64(*columns).alias("__hash"), *columns]


def partials(written: DataFrame) -> DataFrame:
    """What some writes add to each identity and property: rows that ``merged`` can fold again with others.

    (identity, name, born (seq, at), last_seq, matched) and, for each of ``last``, ``once`` and ``again``, the
    place of the write that counts (``_at``) and its value.  A row with a null name is a write without properties.
    """
    single = written.select(*IDENTITY, "seq", "at", "matched", F.explode_outer("writes").alias("w")).select(*IDENTITY, "seq", "at", "matched", "w.*")
    # What is not known is not kept, but the write makes its node or edge all the same.
    unknown = (F.col("policy") == KEEP) & F.col("value").isNull()
    single = single.withColumns({c: F.when(~F.coalesce(unknown, F.lit(False)), F.col(c)) for c in ("name", "policy")})
    place = F.struct("seq", "at")
    # Of writes in one place (a redelivered event) the larger value wins, so reruns agree.
    ranked = F.struct("seq", "at", F.col("value").cast("string").alias("shown"))
    of = lambda *policies: F.when(F.col("policy").isin(*policies), ranked)
    added = single.groupBy(*_keyed(*_NAMED)).agg(
        F.min(place).alias("born"),
        F.max("seq").alias("last_seq"),
        F.min("matched").alias("matched"),
        F.max(of(SET, KEEP)).alias("last_at"),
        F.max_by("value", of(SET, KEEP)).alias("last"),
        F.min(of(ONCE)).alias("once_at"),
        F.min_by("value", of(ONCE)).alias("once"),
        F.max(of(AGAIN)).alias("again_at"),
        F.max_by("value", of(AGAIN)).alias("again"),
    )
    return added.drop("__hash")


def merged(parts: DataFrame) -> DataFrame:
    """Partials of several batches as those of all of them; a batch that is there twice changes nothing."""
    whole = parts.groupBy(*_keyed(*_NAMED)).agg(
        F.min("born").alias("born"),
        F.max("last_seq").alias("last_seq"),
        F.min("matched").alias("matched"),
        F.max("last_at").alias("last_at"),
        F.max_by("last", "last_at").alias("last"),
        F.min("once_at").alias("once_at"),
        F.min_by("once", "once_at").alias("once"),
        F.max("again_at").alias("again_at"),
        F.max_by("again", "again_at").alias("again"),
    )
    return whole.drop("__hash")


def finished(parts: DataFrame) -> DataFrame:
    """The rows of ``folded`` from partials with one row for each identity and property."""
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.seq").alias("seq"), F.col(f"{c}.at").alias("at"))).alias(c)
    entry = F.struct("name", "last", "once", place("once_at"), "again", place("again_at"))
    whole = parts.groupBy(*_keyed(*IDENTITY)).agg(F.min("born").alias("born"), F.max("last_seq").alias("last_seq"), F.min("matched").alias("matched"), F.collect_list(F.when(F.col("name").isNotNull(), entry)).alias("entries"))
    value = lambda e: F.coalesce(e["last"], F.when(e["again_at"] > F.col("born"), e["again"]), F.when(e["once_at"] == F.col("born"), e["once"]))
    known = F.filter(F.transform("entries", lambda e: F.struct(e["name"].alias("name"), value(e).alias("value"))), lambda e: e["value"].isNotNull())
    return whole.select(*IDENTITY, "matched", "born", "last_seq", F.map_from_entries(known).alias("props"))


def _slots(items: dict[int, Node | Edge]) -> tuple[dict[tuple[str, str, str], list[str]], list[dict[int, int]]] | None:
    """Names of the properties of each sort of identity, and for each place in those lists where (numbered) items write it.

    None if an item writes a property twice.
    """
    names, places = {}, []
    for at, item in items.items():
        sort = ("", item.label, "") if isinstance(item, Node) else (item.kind, item.src[0], item.dst[0])
        written = [n for props in (item.props, item.keep, item.once, item.again) for n in props]
        if len(set(written)) < len(written):
            return None
        known = names.setdefault(sort, [])
        known += [n for n in written if n not in known]
        places += [{} for _ in range(len(known) - len(places))]
        for i, n in enumerate(written):
            places[known.index(n)][at] = i
    return names, places


def _used(items: dict[int, Node | Edge], names: dict[tuple[str, str, str], list[str]], places: list[dict[int, int]]) -> list[set[str]]:
    """The policies that the properties in each place are written by."""
    return [{p for item in items.values() for p, props in ((SET, item.props), (KEEP, item.keep), (ONCE, item.once), (AGAIN, item.again)) if set(props) & {k[i] for k in names.values() if len(k) > i}} for i in range(len(places))]


def _entries(places: list[dict[int, int]]) -> list:
    """What a row of ``writes`` has for each place."""
    return [F.get("writes", F.expr("case at " + " ".join(f"when {at} then {i}" for at, i in of.items()) + " end")) for of in places]


def _with_props(whole: DataFrame, names: dict[tuple[str, str, str], list[str]], used: list[set[str]], *others: str) -> DataFrame:
    """The rows of ``folded`` from identities with ``last``, ``once``, ``once_at``, ``again`` and ``again_at`` of each place."""

    def slot(i: int):
        sorts = " ".join(f"when kind = '{kind}' and src_label = '{src}' and dst_label = '{dst}' then '{known[i]}'" for (kind, src, dst), known in names.items() if len(known) > i)
        values = [F.col(f"last{i}")] * bool(used[i] & {SET, KEEP})
        values += [F.when(F.col(f"again_at{i}") > F.col("born"), F.col(f"again{i}"))] * (AGAIN in used[i])
        values += [F.when(F.col(f"once_at{i}") == F.col("born"), F.col(f"once{i}"))] * (ONCE in used[i])
        return F.struct(F.expr(f"case {sorts} end").alias("name"), F.coalesce(*values).alias("value"))

    made = F.array(*map(slot, range(len(used)))) if used else F.array().cast("array<struct<name:string,value:variant>>")
    return whole.select(*IDENTITY, "matched", "born", "last_seq", F.map_from_entries(F.filter(made, lambda e: e["value"].isNotNull())).alias("props"), *others)


def _aggregates(places: list[dict[int, int]], used: list[set[str]]) -> list:
    """What counts for an identity and for each place of its properties."""
    aggregates = [F.min(F.struct("seq", "at")).alias("born"), F.max("seq").alias("last_seq"), F.min("matched").alias("matched")]
    for i, e in enumerate(_entries(places)):
        place, value, policy = F.struct("seq", "at"), e["value"], e["policy"]
        # As in ``partials``: the larger of two values in one place.
        ranked = F.struct("seq", "at", value.cast("string").alias("shown"))
        if used[i] & {SET, KEEP}:
            aggregates.append(F.max_by(value, F.when((policy == SET) | ((policy == KEEP) & value.isNotNull()), ranked)).alias(f"last{i}"))
        if ONCE in used[i]:
            aggregates += [F.min(F.when(policy == ONCE, place)).alias(f"once_at{i}"), F.min_by(value, F.when(policy == ONCE, ranked)).alias(f"once{i}")]
        if AGAIN in used[i]:
            aggregates += [F.max(F.when(policy == AGAIN, place)).alias(f"again_at{i}"), F.max_by(value, F.when(policy == AGAIN, ranked)).alias(f"again{i}")]
    return aggregates


def folded(written: DataFrame, program: tuple = ()) -> DataFrame:
    """One row per identity: (identity, matched, born, last_seq, props map<string,variant>).

    ``born`` (seq, at) is the identity's first write; later events win, then later items of a program.  A
    hot identity is combined map-side; what is held for one is bounded by its program's properties.

    With the ``program`` that wrote, numbered from 0, properties are folded side by side: one aggregation with a row
    for each write, where without it each property is a row that is shuffled twice.
    """
    items = dict(enumerate(program))
    slots = _slots(items) if program else None
    if slots is None:
        return finished(partials(written))
    names, places = slots
    used = _used(items, names, places)
    return _with_props(written.groupBy(*_keyed(*IDENTITY)).agg(*_aggregates(places, used)), names, used)


def _owned(program: tuple, owner: str) -> dict[int, tuple[str, str, str]]:
    """The items whose identities are an event's own (at: sort): their source is the event's key, and nothing else writes that sort."""
    made = [(at, item, _sort(*row[:3]), row[1][1], n == len(rows) - 1) for at, item in enumerate(program) for rows in [_made(item, program[:at])] for n, row in enumerate(rows)]
    of: dict[tuple, list] = {}
    for row in made:
        of.setdefault(row[2], []).append(row)
    one = [rows[0] for rows in of.values() if len(rows) == 1]
    return {at: sort for at, item, sort, key, main in one if key == owner and main and not item.each and not (isinstance(item, Edge) and item.matched)}


def _settled(item: Node | Edge) -> list[tuple[str, str]]:
    """(name, expression) of the properties that a single write leaves."""
    return [pair for props in (item.props, item.keep, item.once) for pair in props.items()]


#: The kind of a row that holds all that is an event's own.
_PACK = "*"


def folded_events(events: DataFrame, program: tuple, owner: str = "event_id", order: str = "arrival_seq") -> DataFrame:
    """``folded(writes(events, program), program)``, with what is an event's own in one row until it has been shuffled.

    A node with the key of its event, and edges from it, are written once if the keys of events are: then one row has
    their ends and properties, where each would be a row.  Keys are looked at first, by their hashes alone; if any is
    there twice, as after a redelivery, each identity is folded by itself.
    """
    own = _owned(program, owner)
    shared = {at: item for at, item in enumerate(program) if at not in own}
    slots = _slots(shared)
    if len(own) < 2 or owner not in events.columns or _slots(dict(enumerate(program))) is None:
        return folded(writes(events, program, order), program)
    if not events.where(F.col(owner).isNotNull()).groupBy(F.xxhash64(owner).alias("h")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return folded(writes(events, program, order), program)
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in events.columns}
    fields = []
    for at in own:
        item = program[at]
        dst, tag = ("''", "''") if isinstance(item, Node) else (item.dst[1], item.tag)
        fields += [F.expr(f"if({_there(item)}, cast({dst} as string), cast(null as string))").alias(f"dst{at}")]
        fields += [F.expr(f"cast({tag} as string)").alias(f"tag{at}")] * (tag != "''")
        fields += [F.expr(e).alias(f"value{at}_{i}") for i, (_, e) in enumerate(_settled(item))]
    pack = f"if({owner} is not null, cast(array({_row(_PACK, ('', owner), _NOTHING, "''", -1, False, f'cast(array() as {_PROPS})')}) as {_ROWS}), cast(array() as {_ROWS}))"
    rest = [_rows(item, at, program[:at], frozenset(own.values())) for at, item in enumerate(program)]
    written = events.withColumns(missing).select(F.col(order).cast("long").alias("seq"), F.struct(*fields).alias("own"), F.explode(F.expr(f"concat({', '.join([pack, *rest])})")).alias("w"))
    written = written.select("seq", "w.*", F.when(F.col("w.kind") == _PACK, F.col("own")).alias("own"))
    names, places = slots
    used = _used(shared, names, places)
    whole = written.groupBy(*_keyed(*IDENTITY)).agg(*_aggregates(places, used), F.first("own", ignorenulls=True).alias("own"))
    columns = [*IDENTITY, "matched", "born", "last_seq", "props"]

    def unpacked(at: int, kind: str, src_label: str, dst_label: str):
        item = program[at]
        entries = [F.struct(F.lit(n).alias("name"), F.col(f"own.value{at}_{i}").cast("variant").alias("value")) for i, (n, _) in enumerate(_settled(item))]
        props = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()) if entries else F.array().cast("array<struct<name:string,value:variant>>"))
        tag = F.lit("") if isinstance(item, Node) or item.tag == "''" else F.col(f"own.tag{at}")
        values = [F.lit(kind), F.lit(src_label), F.col("src"), F.lit(dst_label), F.col(f"own.dst{at}"), tag, F.lit(False), F.struct(F.col("last_seq").alias("seq"), F.lit(at).alias("at")), F.col("last_seq"), props]
        return F.when(F.col(f"own.dst{at}").isNotNull(), F.struct(*[v.alias(c) for v, c in zip(values, columns)]))

    itself = F.when(F.col("kind") != _PACK, F.struct(*columns))
    rows = _with_props(whole, names, used, "own").select(F.explode(F.array(itself, *[unpacked(at, *sort) for at, sort in own.items()])).alias("r"))
    return rows.where("r is not null").select("r.*")


class Sides:
    """``partials``, ``merged`` and ``finished`` with a row for each identity, its properties side by side as in ``folded``.

    ``programs``: each with the number of its first item, as for ``writes_of``.  ``fit`` is false if an item writes a
    property twice; then only rows for each property will do.
    """

    def __init__(self, programs: dict[int, tuple]):
        items = {first + at: item for first, program in programs.items() for at, item in enumerate(program)}
        slots = _slots(items)
        self.fit = slots is not None
        self.names, self.places = slots or ({}, [])
        self.used = _used(items, self.names, self.places)

    def _of(self, i: int) -> list[str]:
        return [n for n, policies in (("last", {SET, KEEP}), ("once", {ONCE}), ("again", {AGAIN})) if self.used[i] & policies]

    def partials(self, written: DataFrame) -> DataFrame:
        """(identity, born, last_seq, matched) and, for each place, what counts (``last0``) and where it was written (``last_at0``)."""
        aggregates = [F.min(F.struct("seq", "at")).alias("born"), F.max("seq").alias("last_seq"), F.min("matched").alias("matched")]
        for i, e in enumerate(_entries(self.places)):
            value, policy = e["value"], e["policy"]
            counts = {"last": (policy == SET) | ((policy == KEEP) & value.isNotNull()), "once": policy == ONCE, "again": policy == AGAIN}
            for n in self._of(i):
                at = F.when(counts[n], F.struct("seq", "at", value.cast("string").alias("shown")))
                least, by = (F.min, F.min_by) if n == "once" else (F.max, F.max_by)
                aggregates += [least(at).alias(f"{n}_at{i}"), by(value, at).alias(f"{n}{i}")]
        return written.groupBy(*_keyed(*IDENTITY)).agg(*aggregates).drop("__hash")

    def merged(self, parts: DataFrame) -> DataFrame:
        """Partials of several batches as those of all of them; a batch that is there twice changes nothing."""
        aggregates = [F.min("born").alias("born"), F.max("last_seq").alias("last_seq"), F.min("matched").alias("matched")]
        for i in range(len(self.places)):
            for n in self._of(i):
                least, by = (F.min, F.min_by) if n == "once" else (F.max, F.max_by)
                aggregates += [least(f"{n}_at{i}").alias(f"{n}_at{i}"), by(f"{n}{i}", f"{n}_at{i}").alias(f"{n}{i}")]
        return parts.groupBy(*_keyed(*IDENTITY)).agg(*aggregates).drop("__hash")

    def finished(self, parts: DataFrame) -> DataFrame:
        """The rows of ``folded`` from partials with one row for each identity."""
        place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.seq").alias("seq"), F.col(f"{c}.at").alias("at")))
        at = [f"{n}_at{i}" for i in range(len(self.places)) for n in self._of(i) if n != "last"]
        return _with_props(parts.withColumns({c: place(c) for c in at}), self.names, self.used)


def nodes_of(graph: DataFrame) -> DataFrame:
    """(label, key, props, born) of a folded graph."""
    return graph.where("kind = ''").select(F.col("src_label").alias("label"), F.col("src").alias("key"), "props", F.col("born.seq").alias("born"))


def matches(*programs: tuple) -> bool:
    """Whether a program has edges that are only there if their target is."""
    return any(isinstance(item, Edge) and item.matched for program in programs for item in program)


def present(graph: DataFrame, matched: bool = True) -> DataFrame:
    """(kind, src_label, src, dst_label, dst, tag, props): nodes (empty kind), and edges whose matched targets are there.

    Looking for targets reads the graph again; ``matched`` false (see ``matches``) leaves that out, and all is one pass.
    """
    columns = [*IDENTITY, "props"]
    if not matched:
        return graph.select(*columns)
    target = nodes_of(graph).select(F.col("label").alias("dst_label"), F.col("key").alias("dst"), F.col("born").alias("there_from"))
    met = graph.where("matched").join(target, ["dst_label", "dst"]).where("there_from <= last_seq")
    return graph.where("not matched").select(*columns).unionByName(met.select(*columns))


def edges_of(graph: DataFrame, matched: bool = True) -> DataFrame:
    """The edges of ``present``."""
    return present(graph, matched).where("kind <> ''")


def build(events: DataFrame, program: tuple, order: str = "arrival_seq") -> tuple[DataFrame, DataFrame]:
    """[S10] Nodes and edges that ``events`` leave."""
    graph = folded(writes(events, program, order), program)
    return nodes_of(graph), edges_of(graph, matches(program))


def edge_table(edges: DataFrame, kind: str) -> DataFrame:
    """(src, dst, props) of one kind, for ``patterns``."""
    return edges.where(F.col("kind") == kind).select("src", "dst", "props")


def shown(props: str = "props"):
    """Properties as text, ``name=value`` by name, joined by semicolons."""
    pairs = F.array_sort(F.map_entries(F.transform_values(props, lambda _, v: v.cast("string"))))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"])), ";")
