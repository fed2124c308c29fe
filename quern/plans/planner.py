"""Planning: kind of a question, retrieval plan, and bounds on how much is retrieved.

``classified`` and ``planned`` work on whole DataFrames of questions; the driver's control loop uses the
same tables for a single question (``plan_one``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """A kind of request: its keywords (substrings of the lower-cased question), cap, prefix and reason."""

    name: str
    keywords: tuple[str, ...]
    cap: int
    prefix: str
    reason: str


#: Clinical plans in order of precedence; the last two are chosen by scope.
CLINICAL = (
    Plan("medication_safety", ("contraindication", "interaction", "adverse", "medication"), 6, "Medication safety focus: ", "Question contains medication safety semantics."),
    Plan("lab_interpretation", ("potassium", "lab", "observation", "vital"), 6, "Lab interpretation focus: ", "Question contains lab or observation semantics."),
    Plan("coding_review", ("claim", "coding", "icd", "cpt", "denial"), 6, "Coding and claims focus: ", "Question contains coding or claims semantics."),
    Plan("cohort_triage", ("cohort", "population", "across patients"), 8, "Cohort triage focus ({scope}): ", "Question implies cohort-level triage or lacks explicit patient scope."),
    Plan("patient_summary", (), 5, "", "Default patient summary path."),
)
#: Supply-chain plans in order of precedence; the last is the default.
SUPPLY = (
    Plan("supplier_risk", ("risk", "single source", "geopolitical", "exposure", "vulnerability"), 8, "Supplier risk assessment focus: ", "Question contains supplier risk semantics."),
    Plan("shipment_tracking", ("shipment", "transit", "delivery", "tracking", "delayed", "customs"), 8, "Shipment and logistics focus: ", "Question contains shipment or logistics semantics."),
    Plan("quality_review", ("quality", "defect", "inspection", "rejection", "corrective"), 8, "Quality inspection and defect focus: ", "Question contains quality or defect semantics."),
    Plan("disruption_impact", ("disruption", "shutdown", "closure", "strike", "disaster", "outage"), 8, "Disruption impact analysis focus: ", "Question contains disruption or outage semantics."),
    Plan("inventory_planning", ("inventory", "stock", "reorder", "days of supply", "shortage"), 8, "Inventory and reorder focus: ", "Question contains inventory or stock semantics."),
    Plan("procurement_overview", (), 8, "Procurement overview: ", "Default procurement overview path."),
)
#: A cohort is never narrowed below so many hits.
COHORT_LEAST = 3


def classified(question: Column, scope: Column | None, plans: tuple[Plan, ...] = CLINICAL, whole_words: bool = False) -> Column:
    """[Q01, Q03, F12] Name of the first plan with a keyword in the question.

    Keywords match anywhere in a word, as in ``available`` for ``lab``; ``whole_words`` forbids that.
    For clinical plans a missing ``scope`` makes an unmatched question a cohort question.
    """
    text, out = F.lower(question), F
    for plan in plans:
        hit = F.lit(False)
        if plan.keywords:
            alternatives = "|".join(plan.keywords)
            hit = text.rlike(rf"\b({alternatives})\b" if whole_words else alternatives)
        if plan.name == "cohort_triage" and scope is not None:
            hit = hit | F.coalesce(scope == "", F.lit(True))
        if plan is plans[-1]:
            return out.otherwise(plan.name)
        out = out.when(hit, plan.name)
    raise ValueError("no plans")


def bounded(limit: Column, cap: int) -> Column:
    """[O06] At least one, at most ``cap``."""
    return F.greatest(F.lit(1), F.least(limit, F.lit(cap)))


def planned(question: Column, kind: Column, scope: Column, limit: Column, plans: tuple[Plan, ...] = CLINICAL) -> Column:
    """[Q02] struct<name,query_text,top_k,reason> for classified questions."""
    out = F
    at_least_one = F.greatest(F.lit(1), limit)
    for plan in plans:
        prefix = F.lit(plan.prefix)
        top = bounded(at_least_one, plan.cap)
        if "{scope}" in plan.prefix:
            before, after = plan.prefix.split("{scope}")
            prefix = F.concat(F.lit(before), F.when(F.coalesce(scope == "", F.lit(True)), "cohort").otherwise("patient plus cohort"), F.lit(after))
            top = F.least(at_least_one, F.greatest(F.lit(COHORT_LEAST), top))
        made = F.struct(F.lit(plan.name).alias("name"), F.concat(prefix, question).alias("query_text"), top.cast("int").alias("top_k"), F.lit(plan.reason).alias("reason"))
        out = out.when(kind == plan.name, made)
    return out


def plan_one(question: str, scope: str | None, limit: int, plans: tuple[Plan, ...] = CLINICAL) -> dict:
    """The same for one question, without Spark."""
    text = question.lower()
    cohort = next((p for p in plans if p.name == "cohort_triage"), None)
    chosen = next((p for p in plans if any(k in text for k in p.keywords)), cohort if cohort and not scope else plans[-1])
    limit = max(1, limit)
    top = min(limit, chosen.cap)
    if chosen is cohort:
        top = min(limit, max(COHORT_LEAST, top))
    prefix = chosen.prefix.format(scope="patient plus cohort" if scope else "cohort")
    return {"name": chosen.name, "query_text": prefix + question, "top_k": top, "reason": chosen.reason}


def skill_plans(goals: DataFrame, skills: DataFrame, needs: list[str]) -> DataFrame:
    """[Q22, J20, U07] (goal, skills, needs): each goal's skills (goal, skills array) and what they need (skill, arrays).

    Every need is there once, in the order in which the skills first mention it; a goal without skills needs
    nothing, skills that are not there are left out of the needs.
    """
    named = goals.select("goal", F.posexplode("skills").alias("place", "skill")).join(skills, "skill", "left")
    # What a goal lists is bounded by the layer's file.
    found = named.groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("place", *needs))).alias("in_order"))
    none = F.array().cast("array<string>")
    once = {n: F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(f"in_order.{n}"), F.array().cast("array<array<string>>")), lambda x: F.coalesce(x, none)))) for n in needs}
    return goals.join(found, "goal", "left").select("goal", "skills", *[c.alias(n) for n, c in once.items()])
