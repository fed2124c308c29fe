"""The clinical tools over DataFrames: each is a query of bounded result for one request.

``context`` has a row per patient (``patient_id`` and lists), ``points`` a row per event (``event_id``,
``patient_id``, ``event_type``, ``embedding``, ``text``), ``timeline`` likewise (``patient_id``, ``event_ts``,
``event_id``, ``event_type``).  Filters reach the scans; what comes to the driver is a top-k or one patient.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import evidence, patterns, similarity, specialists
from quern.plans import control, planner
from quern.plans.tools import Tools, built_response, skill_plan, validated

#: Events of a timeline, and patients of a cohort, that a tool returns at most.
TIMELINE_EVENTS = 25
COHORT = 20


def search(points: DataFrame, question: str, k: int, patient_id: str | None = None) -> DataFrame:
    """[Q14, O04] The points nearest to a question, of one patient or all."""
    asked = points.sparkSession.range(1).select(V.embedding(F.lit(question)).alias("embedding"))
    keep = F.col("patient_id") == patient_id if patient_id else None
    return similarity.nearest(points, asked, k, id_col="event_id", keep=keep)


def lookup(context: DataFrame, patients: list[str]) -> DataFrame:
    """[Q14, F03] The contexts of some patients."""
    return patterns.restricted(context, "patient_id", patients)


def _rows(frame: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.limit(limit).collect()]


def single_pass(question: str, patient_id: str | None, context: DataFrame, points: DataFrame, model: Callable[[str], str], limit: int = 8) -> dict:
    """[Q08, Q10] Plan, search, look up, route to a specialist, render, answer."""
    plan = planner.plan_one(question, patient_id, limit)
    hits = _rows(evidence.ranked_hits(search(points, question, plan["top_k"], patient_id), plan["name"]), plan["top_k"])
    patients = sorted({h["patient_id"] for h in hits if h["patient_id"]} | ({patient_id} if patient_id else set()))
    found = lookup(context, patients) if patients else context.limit(0)
    graph = _rows(found.orderBy("patient_id"), max(1, len(patients)))
    wanted = control.specialist(plan["name"])
    findings = _rows(SPECIALISTS[wanted](found), len(patients)) if wanted and patients else []
    prompt = control.patient_prompt(question, hits, graph)
    answer = control.retried(lambda: model(prompt))
    reasons = _rows(context.sparkSession.range(1).select(T.output_reasons(F.lit(answer), F.lit(bool(hits or graph))).alias("r")), 1)[0]["r"]
    trace = [{"agent": "triage", "request_type": plan["name"]}, {"agent": "vector_retrieval", "hits": len(hits)}, {"agent": "graph_retrieval", "patients": len(graph)}] + ([{"agent": plan["name"], "findings": len(findings)}] if wanted else [])
    return {"question": question, "request_type": plan["name"], "retrieval_plan": plan, "patients": patients, "vector_context": hits, "graph_context": graph, "findings": findings, "answer": answer, "guard_reasons": reasons, "trace": trace, "confidence": (bool(hits) + bool(graph)) / 2}


SPECIALISTS = {"medication": specialists.medication_safety, "laboratory": specialists.lab_interpretation, "coding": specialists.coding_review}


def register(desk: Tools, context: DataFrame, points: DataFrame, timeline: DataFrame, model: Callable[[str], str], skills: dict | None = None) -> Tools:
    """[Q15] The ten tools and ``query``, registered with ``desk``."""

    def patient_context_get(patient_id: str, include_claims: bool = True, include_interactions: bool = True) -> dict:
        validated("patient_context_get", {"patient_id": patient_id, "include_claims": int(include_claims), "include_interactions": int(include_interactions)})
        left_out = [c for c, kept in (("claims", include_claims), ("interactions", include_interactions)) if not kept]
        found = _rows(patterns.without(lookup(context, [patient_id]), *left_out), 1)
        return {"patient": found[0] if found else None}

    def vector_evidence_search(question: str, patient_id: str | None = None, top_k: int = 5) -> dict:
        validated("vector_evidence_search", {"question": question, "patient_id": patient_id, "top_k": top_k})
        return {"hits": _rows(evidence.redacted(search(points, question, top_k, patient_id), "read_only"), top_k)}

    def query(question: str, patient_id: str | None = None, role: str = "generation") -> dict:
        validated("query", {"question": question, "patient_id": patient_id})
        return built_response(single_pass(question, patient_id, context, points, model), role, "bounded" if role == "export" else "none")

    def graph_answer_generate(question: str, patient_id: str | None = None, response_style: str = "concise") -> dict:
        validated("graph_answer_generate", {"question": question, "patient_id": patient_id, "response_style": response_style})
        return query(question, patient_id) | {"response_style": response_style}

    def recent(patient_id: str, hours: int) -> DataFrame:
        mine = timeline.where(F.col("patient_id") == patient_id)
        last = mine.agg(F.max("event_ts")).first()[0]
        return mine.where(F.col("event_ts") >= F.lit(last) - F.expr(f"interval {int(hours)} hours")) if last is not None else mine

    def risk_summary_generate(patient_id: str, time_window_hours: int = 24) -> dict:
        validated("risk_summary_generate", {"patient_id": patient_id, "time_window_hours": time_window_hours})
        return {"risks": _rows(specialists.medication_safety(lookup(context, [patient_id])), 1), "events": _rows(recent(patient_id, time_window_hours).groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type"), 100)}

    def timeline_explain(patient_id: str, time_window_hours: int = 24) -> dict:
        validated("timeline_explain", {"patient_id": patient_id, "time_window_hours": time_window_hours})
        return {"timeline": _rows(recent(patient_id, time_window_hours).orderBy(F.desc("event_ts"), "event_id"), TIMELINE_EVENTS)}

    def medication_risk_assess(patient_id: str) -> dict:
        return {"findings": _rows(specialists.medication_safety(lookup(context, [patient_id])), 1)}

    def coding_gap_detect(patient_id: str) -> dict:
        return {"findings": _rows(specialists.coding_review(lookup(context, [patient_id])), 1)}

    def cohort_risk_summary() -> dict:
        sized = context.select("patient_id", F.size("conditions").alias("n_conditions"), F.size("observations").alias("n_observations"))
        return {"cohort": _rows(evidence.ranked_entities(sized, "patient_id", "n_conditions", "n_observations"), COHORT)}

    def evidence_bundle_export(question: str, patient_id: str | None = None, include_raw_payload: bool = False) -> dict:
        validated("evidence_bundle_export", {"question": question, "patient_id": patient_id, "include_raw_payload": int(include_raw_payload)})
        return query(question, patient_id, "export")

    def skills_plan_get(goal: str, agent: str | None = None) -> dict:
        return skill_plan(skills or {"business_goals": {}, "skills": {}}, goal, agent)

    for tool in (patient_context_get, vector_evidence_search, skills_plan_get, query, graph_answer_generate, risk_summary_generate, timeline_explain, medication_risk_assess, coding_gap_detect, cohort_risk_summary, evidence_bundle_export):
        desk.register(tool.__name__, tool)
    return desk
