"""Callable tools around the queries: who may call them, what is logged, how an answer is made to fit."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quern.sources.envelopes import audit

#: Tools that each role may call.
POLICY = {
    "read_only": ("patient_context_get", "vector_evidence_search", "skills_plan_get"),
    "generation": ("query", "graph_answer_generate", "risk_summary_generate", "timeline_explain", "medication_risk_assess", "coding_gap_detect", "cohort_risk_summary"),
    "export": ("evidence_bundle_export",),
}
#: Bytes of a response, and how much is cut from the answer at a time.
RESPONSE_BYTES = 50_000
ANSWER_STEP = 80


class NotAuthorised(PermissionError):
    """The role may not call the tool."""


def canonical(value) -> str:
    """[P28] JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def fit_response(response: dict, limit: int = RESPONSE_BYTES) -> dict:
    """[P27] Drop the last hits, then the last graph rows, then shorten the answer, until it fits in bytes."""
    size = lambda: len(canonical(out).encode())
    out = {**response, "vector_context": list(response.get("vector_context", [])), "graph_context": list(response.get("graph_context", []))}
    for part in ("vector_context", "graph_context"):
        while out[part] and size() > limit:
            out[part].pop()
    while out.get("answer") and size() > limit:
        out["answer"] = out["answer"][:-ANSWER_STEP]
    if size() > limit:
        raise RuntimeError("the response does not fit its budget")
    return out


@dataclass(frozen=True)
class Limit:
    """Bounds of a request field: length of a text, size of a number, or a choice."""

    least: int = 1
    most: int = 128
    needed: bool = False
    choices: tuple[str, ...] = ()


#: Fields of requests and their bounds.
QUESTION = Limit(3, 1000, needed=True)
REQUESTS = {
    "query": {"question": QUESTION, "patient_id": Limit()},
    "patient_context_get": {"patient_id": Limit(needed=True), "include_claims": Limit(0, 1), "include_interactions": Limit(0, 1)},
    "vector_evidence_search": {"question": QUESTION, "patient_id": Limit(), "top_k": Limit(1, 5)},
    "graph_answer_generate": {"question": QUESTION, "patient_id": Limit(), "response_style": Limit(choices=("concise", "clinical", "audit"))},
    "risk_summary_generate": {"patient_id": Limit(needed=True), "time_window_hours": Limit(1, 720)},
    "timeline_explain": {"patient_id": Limit(needed=True), "time_window_hours": Limit(1, 720)},
    "evidence_bundle_export": {"question": QUESTION, "patient_id": Limit(), "include_raw_payload": Limit(0, 1)},
}


def validated(name: str, arguments: dict) -> dict:
    """``arguments`` if they are in bounds; unknown or missing fields and wrong sizes are ValueErrors."""
    limits = REQUESTS[name]
    if extra := sorted(set(arguments) - set(limits)):
        raise ValueError(f"unknown fields {extra}")
    for key, limit in limits.items():
        value = arguments.get(key)
        if value is None:
            if limit.needed:
                raise ValueError(f"{key} is missing")
        elif limit.choices:
            if value not in limit.choices:
                raise ValueError(f"{key} must be one of {limit.choices}")
        elif not limit.least <= (len(value) if isinstance(value, str) else int(value)) <= limit.most:
            raise ValueError(f"{key} is out of bounds")
    return arguments


def built_response(result: dict, role: str, access: str, limit: int = RESPONSE_BYTES) -> dict:
    """[Q18, K9] The parts of an answer that a caller sees, how much was withheld, and the loop's trace."""
    kept = {k: result.get(k) for k in ("question", "request_type", "retrieval_plan", "patients", "vector_context", "graph_context", "answer", "trace")}
    guard = {"evidence_text_redacted": access != "bounded", "evidence_access_level": access, "graph_access_level": "broader" if role == "export" else "standard", "max_response_bytes": limit}
    return fit_response({**kept, "vector_context": kept["vector_context"] or [], "graph_context": kept["graph_context"] or [], "guardrails": guard}, limit)


def setting(text: str | None, kind: str = "list"):
    """[P39] A configuration text as a list (comma-separated, blanks left out) or a flag."""
    if kind == "flag":
        return (text or "").strip().lower() in ("1", "true", "yes", "on")
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def graph_sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """[S16] A statement over node and edge tables as temporary views."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    return spark.sql(statement)


@dataclass
class Tools:
    """[Q14, Q15, Q17, F19, S14] Registered tools behind authorisation, with an audit row for every call."""

    spark: SparkSession
    log_path: str | None = None
    policy: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(POLICY))
    tools: dict[str, Callable[..., dict]] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def register(self, name: str, call: Callable[..., dict]) -> None:
        self.tools[name] = call

    def call(self, role: str, name: str, **arguments) -> dict:
        began, row = time.time(), {"role": role, "tool": name, "request_hash": fingerprint(arguments)}
        try:
            if name not in self.policy.get(role, ()):
                row["outcome"] = "denied"
                raise NotAuthorised(f"{role} is not authorized for {name}")
            row["outcome"] = "error"
            answer = self.tools[name](**arguments)
            row |= {"outcome": "success", "response_bytes": len(canonical(answer).encode())}
            return answer
        finally:
            self.log.append(row | {"latency_ms": round(1000 * (time.time() - began), 1)})

    def flush(self) -> int:
        """Append the collected audit rows; how many."""
        rows, self.log = self.log, []
        if rows and self.log_path:
            made = [(r["role"], r["tool"], r["outcome"], r["request_hash"], r.get("response_bytes"), r["latency_ms"]) for r in rows]
            audit(self.spark.createDataFrame(made, "role string, tool string, outcome string, request_hash string, response_bytes long, latency_ms double"), self.log_path)
        return len(rows)


def skill_plan(layer: dict, goal: str, agent: str | None = None) -> dict:
    """[Q22, J20, U07] Skills of a goal and what they need, each thing once in order of first mention."""
    for part in ("business_goals", "skills"):
        if not isinstance(layer.get(part), dict):
            raise ValueError(f"{part} must be an object")
    entry = layer["business_goals"].get(goal)
    if entry is None:
        raise ValueError(f"unknown goal {goal}; there are {sorted(layer['business_goals'])}")
    unknown = [s for s in entry.get("skills", []) if s not in layer["skills"]]
    if unknown:
        raise ValueError(f"goal {goal} names unknown skills {unknown}")
    skills = [{"id": s, **layer["skills"][s]} for s in entry.get("skills", [])]
    needs = {k: list(dict.fromkeys(x for s in skills for x in s.get(k, []))) for k in ("context_requirements", "ontology_dependencies", "mcp_tools", "runtime_tools")}
    return {"goal": goal, "agent": agent or entry.get("default_agent", "default_agent"), "skills": skills, **needs}
