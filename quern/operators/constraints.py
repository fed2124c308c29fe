"""Constraints over tables as data, checked in one pass of each table and one aggregation for all of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What must be there once, by model: labels of nodes and the property that tells them apart.
CLINICAL_KEYS = {
    "Patient": "id", "Encounter": "id", "ClinicalEvent": "id", "Provider": "id", "SourceSystem": "name", "Condition": "name", "Symptom": "name", "Observation": "id", "Medication": "name",
    "MedicationOrder": "id", "Claim": "id", "Procedure": "code", "Payer": "name", "Device": "id", "DeviceReading": "id", "ICD10Code": "code", "AdverseEvent": "id", "AdverseOutcome": "code",
}
SUPPLY_KEYS = {
    "Supplier": "id", "Part": "id", "Facility": "id", "SupplyChainEvent": "id", "PurchaseOrder": "id",
    "Shipment": "id", "QualityInspection": "id", "DisruptionEvent": "id", "RiskSignal": "id", "SourceSystem": "name",
}


@dataclass(frozen=True)
class Constraint:
    """One rule of a table.

    ``needed``, ``length`` (characters), ``range`` and ``among`` look at a row's first column; ``unique`` at all
    columns together; ``foreign`` wants its column to be among those of ``target`` (table, column).  Null breaks
    ``needed`` only.  ``where`` is SQL that picks the rows that a rule is for.
    """

    name: str
    table: str
    kind: str
    columns: tuple[str, ...]
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()
    target: tuple[str, str] | None = None
    where: str = "true"


def _broken(rule: Constraint) -> Column:
    """Whether a row breaks a rule that a row can break by itself."""
    column = F.col(f"`{rule.columns[0]}`")
    if rule.kind == "needed":
        return column.isNull()
    if rule.kind == "among":
        return ~column.isin(*rule.among)
    size = F.char_length(column) if rule.kind == "length" else column
    bounds = [size < rule.low] * (rule.low is not None) + [size > rule.high] * (rule.high is not None)
    return reduce(lambda a, b: a | b, bounds)


def _key(columns: tuple[str, ...]) -> Column:
    """Columns as one text, the same for equal values only; null if one is null."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    return parts[0] if len(parts) == 1 else F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.to_json(F.array(*parts)))


_ENTRY = "array<struct<rule:string,value:string,held:bigint,there:boolean>>"


def violations(tables: dict[str, DataFrame], rules: list[Constraint]) -> DataFrame:
    """[F20, R11, M18] (rule, value, rows): what breaks ``rules``, each value once with how many rows have it.

    A table is read once for all its rules.  Rows meet in one aggregation by (rule, value), map-side for the most
    part; a value that most rows have is one row of each task.
    """
    made = []
    for name, rows in tables.items():
        entries = []
        for rule in rules:
            value = _key(rule.columns if rule.kind in ("unique", "foreign") else rule.columns[:1])
            if rule.table == name:
                counts = F.col("__one") if rule.kind in ("unique", "foreign") else F.when(F.coalesce(_broken(rule), F.lit(False)), F.col("__one"))
                entries.append(F.when(F.expr(rule.where) & counts.isNotNull(), F.struct(F.lit(rule.name).alias("rule"), value.alias("value"), counts.alias("held"), F.lit(False).alias("there"))))
            if rule.target and rule.target[0] == name:
                entries.append(F.struct(F.lit(rule.name).alias("rule"), _key(rule.target[1:]).alias("value"), F.lit(0).cast("long").alias("held"), F.lit(True).alias("there")))
        if entries:
            found = rows.withColumn("__one", F.lit(1).cast("long")).select(F.explode(F.array_compact(F.array(*entries)).cast(_ENTRY)).alias("e")).select("e.*")
            made.append(found)
    counted = reduce(DataFrame.unionByName, made).groupBy("rule", "value").agg(F.sum("held").alias("rows"), F.max("there").alias("there"))
    of = lambda *kinds: F.col("rule").isin(*[r.name for r in rules if r.kind in kinds])
    keyed = F.col("value").isNotNull()
    broken = F.when(of("unique"), keyed & (F.col("rows") > 1)).when(of("foreign"), keyed & ~F.col("there") & (F.col("rows") > 0)).otherwise(F.col("rows") > 0)
    return counted.where(broken).select("rule", "value", "rows")
