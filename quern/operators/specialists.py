"""What specialists read out of a context table (one row per entity, lists as arrays of structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(context: DataFrame, name: str) -> Column:
    """How many values there are: ``n_<list>`` of a context that counts also what its lists leave out, else the list's length."""
    return F.col(f"n_{name}") if f"n_{name}" in context.columns else F.size(name)


def _there(context: DataFrame, *lists: str) -> list[str]:
    """The lists that the context has."""
    return [n for n in lists if n in context.columns]


def _some(*lists: str):
    """[F16] Whether any of the lists has an element."""
    return sum((F.size(n) for n in lists), F.lit(0)) > 0


def medication_safety(context: DataFrame, key: str = "patient_id") -> DataFrame:
    """[Q11, A15] Entities with interactions, adverse events or contraindications, and how many of each in all.

    A context whose lists are cut has the counts beside them (``n_interactions``, ...), or the counts alone.
    """
    lists = {"interaction": "interactions", "adverse_event": "adverse_events", "contraindication": "contraindications"}
    totals = {k: _total(context, n) for k, n in lists.items()}
    found = context.where(sum(totals.values(), F.lit(0)) > 0)
    return found.select(key, *[n.alias(f"{k}_count") for k, n in totals.items()], *_there(context, *lists.values()))


def lab_interpretation(context: DataFrame, key: str = "patient_id") -> DataFrame:
    """[Q11, F15] Entities with signals or abnormal observations."""
    marked = context.withColumn("abnormal_observations", F.filter("observations", lambda o: F.coalesce(o["abnormal"], F.lit(False))))
    found = marked.where(_some("lab_signals", "abnormal_observations"))
    return found.select(key, F.size("lab_signals").alias("lab_signal_count"), F.size("abnormal_observations").alias("abnormal_observation_count"), "lab_signals", "abnormal_observations")


def coding_review(context: DataFrame, key: str = "patient_id") -> DataFrame:
    """[Q11, J18] Entities with claims, or with conditions that no code covers (sorted)."""
    named, coded = F.transform("conditions", lambda c: c["name"]), F.transform("icd10_codes", lambda c: c["condition"])
    marked = context.withColumn("uncoded_conditions", F.array_sort(F.array_except(named, coded)))
    found = marked.where(_some("claims", "uncoded_conditions"))
    return found.select(key, F.size("claims").alias("claim_count"), F.size("icd10_codes").alias("icd10_mapped"), "uncoded_conditions", "claims")


def supplier_risk(context: DataFrame, key: str = "supplier_id") -> DataFrame:
    """[Q12] Suppliers with risk signals, and how many in all."""
    total = _total(context, "risk_signals")
    return context.where(total > 0).select(key, total.alias("signal_count"), *_there(context, "risk_signals"))


def disruption_impact(context: DataFrame, key: str = "supplier_id") -> DataFrame:
    """[Q12] Suppliers with parts that a disruption would reach, and how many in all."""
    total = _total(context, "parts")
    return context.where(total > 0).select(key, total.alias("affected_parts"), *_there(context, "parts"))


def quality_review(context: DataFrame, key: str = "supplier_id") -> DataFrame:
    """[Q12] Suppliers with signals of the kind ``quality``, and how many in all."""
    known = "n_quality" in context.columns
    marked = context if known else context.withColumn("quality", F.filter("risk_signals", lambda s: s["signal"] == "quality"))
    total = _total(marked, "quality")
    return marked.where(total > 0).select(key, total.alias("quality_issues"))


#: Supply risk rules (id, condition over a fact row, severity); an extension that evaluates them.
SUPPLY_RULES = {
    "single_source_critical_part": ("n_suppliers = 1 AND criticality = 'critical'", "high"),
    "lead_time_exceeded": ("actual_lead_days > expected_lead_days * 1.5", "moderate"),
    "quality_rejection_rate": ("defect_rate > 0.05", "high"),
    "geopolitical_risk_region": ("array_contains(high_risk_regions, country)", "moderate"),
    "disruption_cascade": ("disrupted AND n_suppliers = 1", "high"),
}


def supply_signals(facts: DataFrame, rules: dict[str, tuple[str, str]] = SUPPLY_RULES) -> DataFrame:
    """[R10] ``facts`` with ``signals``: (rule_id, severity) of the rules whose columns are there and that hold."""
    import re

    usable = {k: v for k, v in rules.items() if set(re.findall(r"[a-z_]{3,}\b(?!\()", re.sub(r"'[^']*'", "", v[0]))) <= set(facts.columns)}
    held = [F.when(F.expr(e), F.struct(F.lit(k).alias("rule_id"), F.lit(s).alias("severity"))) for k, (e, s) in usable.items()]
    none = F.array().cast("array<struct<rule_id:string,severity:string>>")
    return facts.withColumn("signals", F.array_compact(F.array(*held)) if held else none)
