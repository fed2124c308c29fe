"""Event envelopes: schemas, parsing with quarantine, topic routing, readers and the audit sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of the two event envelopes; all are strings.
CLINICAL_FIELDS = ("event_id", "event_ts", "source_system", "source_type", "event_type", "patient_id", "encounter_id", "provider_id", "payload_json", "schema_version")
SUPPLY_FIELDS = ("event_id", "event_ts", "source_system", "source_type", "event_type", "entity_id", "facility_id", "supplier_id", "payload_json", "schema_version")


def envelope(fields: tuple[str, ...] = CLINICAL_FIELDS) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


#: Payload fields by event type, as Spark DDL.
PAYLOADS = {
    "CLINICAL_NOTE": "diagnosis string, symptom string, note string, system string, icd10_code string, event_family string, allergen string, reaction_severity string",
    "LAB_RESULT": "lab_name string, value string, unit string, abnormal boolean, lab_panel string, specimen_type string",
    "VITAL_SIGN": "device_id string, device_type string, heart_rate int, spo2 int, systolic_bp int, diastolic_bp int, temperature_c double, respiratory_rate int, glucose_mg_dl int, alert string",
    "MEDICATION_ORDER": "medication string, drug_class string, dose string, route string, frequency string, order_type string, days_supply int",
    "CLAIM_STATUS": "claim_id string, payer string, procedure_code string, procedure_description string, diagnosis_code string, billed_amount double, allowed_amount double, status string, claim_type string, service_date string",
    "PURCHASE_ORDER": "po_number string, supplier_id string, part_id string, part_name string, commodity_category string, quantity int, unit_price double, total_value double, currency string, destination_facility string, incoterm string, expected_delivery_date string, status string",
    "SHIPMENT_UPDATE": "shipment_id string, supplier_id string, part_id string, origin_facility string, destination_facility string, transport_mode string, carrier string, container_id string, status string, expected_lead_days int, actual_lead_days int, quantity int, weight_kg double, customs_cleared boolean",
    "QUALITY_RESULT": "inspection_id string, supplier_id string, part_id string, facility_id string, inspection_type string, sample_size int, defects_found int, defect_rate double, result string, defect_categories array<string>, corrective_action_required boolean",
    "DISRUPTION_ALERT": "disruption_id string, facility_id string, disruption_type string, severity string, region string, country string, affected_parts array<string>, estimated_duration_days int, description string, mitigation_status string",
    "INVENTORY_LEVEL": "facility_id string, part_id string, on_hand_qty int, allocated_qty int, in_transit_qty int, reorder_point int, below_reorder boolean, days_of_supply double, warehouse_zone string",
}
#: Payload fields of supply-chain reference records by kind.
REFERENCE_PAYLOADS = {
    "SUPPLIER": "supplier_id string, name string, country string, region string, tier int, risk_score double, iso_certified boolean, geopolitical_risk string",
    "PART": "part_id string, part_name string, commodity_category string, criticality string, lead_time_days int, supplier_count int, single_source boolean",
    "FACILITY": "facility_id string, name string, facility_type string, country string, region string, capacity_utilization double, operational_status string",
}
_MAPPING = "struct<standard_system:string,standard_code:string,display:string>"
#: What enrichment adds to every clinical payload: reference records, and mappings to standard terminologies.
ENRICHED = (
    "reference_data struct<patient:struct<name:string,sex:string,age:int,risk_tier:string>,provider:struct<name:string,specialty:string,organization:string,npi:string>,"
    "device:struct<model:string,vendor:string,device_type:string>,medication:struct<drug_class:string,safety_tier:string>,payer:struct<plan_type:string,region:string,network_tier:string>>, "
    f"semantic struct<observation:struct<mapping:{_MAPPING}>,medication:struct<mapping:{_MAPPING}>,symptom:struct<mapping:{_MAPPING}>,condition:struct<mapping:{_MAPPING}>,"
    f"claim:struct<diagnosis_mapping:{_MAPPING},procedure_mapping:{_MAPPING}>,reference_context:struct<patient:struct<sex_mapping:{_MAPPING},risk_tier_mapping:{_MAPPING}>,"
    f"provider:struct<specialty_mapping:{_MAPPING}>,device:struct<device_type_mapping:{_MAPPING}>,medication:struct<drug_class_mapping:{_MAPPING},safety_tier_mapping:{_MAPPING}>,"
    f"payer:struct<plan_type_mapping:{_MAPPING},network_tier_mapping:{_MAPPING}>>>"
)
CLINICAL_TYPES = ("CLINICAL_NOTE", "LAB_RESULT", "VITAL_SIGN", "MEDICATION_ORDER", "CLAIM_STATUS")
SUPPLY_TYPES = ("PURCHASE_ORDER", "SHIPMENT_UPDATE", "QUALITY_RESULT", "DISRUPTION_ALERT", "INVENTORY_LEVEL")


def payload_schema(*fields: str) -> str:
    """Field lists (Spark DDL without nested commas) as one, each field once; two types for a name are an error."""
    found: dict[str, str] = {}
    for part in fields:
        for name, kind in (f.split(" ", 1) for f in part.split(", ")):
            if found.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is {found[name]} and {kind}")
    return ", ".join(f"{n} {k}" for n, k in found.items())


def clinical_payload() -> str:
    """Schema of any clinical payload, enriched."""
    return payload_schema(*[PAYLOADS[k] for k in CLINICAL_TYPES]) + ", " + ENRICHED


def supply_payload() -> str:
    return payload_schema(*[PAYLOADS[k] for k in SUPPLY_TYPES])


def route(topic: Column, reference: list[str], event: list[str]) -> Column:
    """[S05] ``reference``, ``event`` or ``skipped``."""
    return F.when(topic.isin(reference), "reference").when(topic.isin(event), "event").otherwise("skipped")


def kafka(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """[S01, U01] All topics as one stream from the earliest offset: (topic, raw, arrival_seq)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
    return reader.load().select("topic", F.col("value").cast("string").alias("raw"), F.col("offset").alias("arrival_seq"))


def deserialised(raw: DataFrame, fields: tuple[str, ...] = CLINICAL_FIELDS) -> DataFrame:
    """[S03, S04, T10] ``raw`` with ``event`` and ``problem``: null, or why the row belongs in quarantine.

    JSON objects are parsed; anything else, or an envelope without id or type, or with a payload that
    is not an object, is a problem.  A missing payload is an empty object.
    """
    event = F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", envelope(fields)))
    parsed = raw.withColumn("event", event)
    payload = F.try_parse_json(F.coalesce("event.payload_json", F.lit("{}")))
    problem = (
        F.when(F.col("event").isNull(), "not a JSON object")
        .when(F.col("event.event_id").isNull() | F.col("event.event_type").isNull(), "no id or type")
        .when(payload.isNull() | ~F.schema_of_variant(payload).startswith("OBJECT"), "payload is not an object")
    )
    return parsed.withColumn("problem", problem)


def payload_of(events: DataFrame, event_type: str, payload: str = "payload_json") -> DataFrame:
    """[S04, S06] Events of one type with their payload as typed struct ``payload``; unknown keys are ignored."""
    typed = F.from_json(F.coalesce(payload, F.lit("{}")), PAYLOADS[event_type])
    return events.where(F.col("event_type") == event_type).withColumn("payload", typed)


def with_payload(events: DataFrame, schema: str, payload: str = "payload_json") -> DataFrame:
    """[S04] Events of any type with ``payload`` parsed once; fields that a type lacks are null."""
    return events.withColumn("payload", F.from_json(F.coalesce(payload, F.lit("{}")), schema))


def audit(rows: DataFrame, path: str) -> None:
    """[S14] Append rows as JSON lines, stamped."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def synthetic_events(spark: SparkSession, n: int, owners: int = 1000, hot: int = 120, partitions: int | None = None) -> DataFrame:
    """[S15] Deterministic lab events with hot owners (70 % of rows from ``hot`` of them), late arrivals and corrections.

    Everything is an expression of the row number, so a rerun or a lost partition gives the same rows.
    """
    names = F.array(*[F.lit(x) for x in ("Potassium", "Glucose", "HbA1c", "Creatinine", "Sodium", "TSH")])
    dice = lambda salt, sides: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(sides))
    owner = F.when(dice("hot", 100) < 70, dice("owner", hot)).otherwise(hot + dice("owner", owners - hot))
    late = F.when(dice("late", 100) < 12, dice("minutes", 180))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(
        F.concat(F.lit("ev-"), F.col("id").cast("string")).alias("event_id"),
        F.col("id").alias("arrival_seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") - F.coalesce(late * 60, F.lit(0))).alias("event_ts"),
        F.lit("LAB_RESULT").alias("event_type"),
        F.concat(F.lit("p-"), owner.cast("string")).alias("patient_id"),
        F.element_at(names, (dice("name", 6) + 1).cast("int")).alias("lab_name"),
        (dice("value", 20000) / 100).alias("value"),
        (dice("correction", 100) < 6).alias("is_correction"),
    )
