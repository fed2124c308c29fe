"""String and JSON column builders: normalisation, templates, truncation, guards.

All of them are built-in expressions, so they stay inside code generation and can be used on batch and
streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """[P01] Trimmed, runs of white space as one space; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def title(text: Column) -> Column:
    """[P02] Every run of ASCII letters capitalised (``HbA1c`` gives ``Hba1C``), after ``squeeze``."""
    runs = F.regexp_extract_all(squeeze(text), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))), "")


def folded(code: Column) -> Column:
    """[P03] Key for case-insensitive lookups: squeezed and lower-cased."""
    return F.lower(squeeze(code))


def shown(value: Column, as_bool: bool = False) -> Column:
    """[P08] A value in a template: null as ``None``, booleans as ``True`` and ``False``."""
    text = F.initcap(value.cast("string")) if as_bool else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def sentences(*parts: Column) -> Column:
    """[P09] Parts joined by spaces; those that are null, empty or mention ``None`` are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda s: s.isNotNull() & (s != "") & ~F.contains(s, F.lit("None"))), " ")


def template(pattern: str, payload: Column, *fields: str) -> Column:
    """``pattern`` filled with JSON fields as they are written in ``payload`` (numbers keep their form)."""
    return F.format_string(pattern, *[shown(F.get_json_object(payload, f"$.{f}")) for f in fields])


def truncated(text: Column, limit: int) -> Column:
    """[P23] At most ``limit`` characters, the last three dots if cut; up to three: cut hard."""
    cut = F.left(text, F.lit(limit)) if limit <= 3 else F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def short_hash(text: Column, digits: int = 12) -> Column:
    """[P29] The first hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def point_id(key: Column) -> Column:
    """[P15] Unsigned 64-bit id: the first 16 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(key), 1, 16), 16, 10).cast("decimal(20,0)")


def pressure(systolic: Column, diastolic: Column) -> Column:
    """[P19] ``120/80``; null if either is."""
    return F.concat(systolic.cast("string"), F.lit("/"), diastolic.cast("string"))


#: What an input may not contain, by family; the first hit of a family counts.
INPUT_GUARDS = {
    "prompt_injection_detected": r"(?i)ignore\s+(all\s+)?previous\s+instructions|system\s*:\s*you\s+are|<\s*/?\s*system\s*>|\bDAN\b.*\bjailbreak\b|pretend\s+you\s+are\s+(not\s+)?a",
    "sensitive_data_in_input": r"\b\d{3}-\d{2}-\d{4}\b|\b\d{16}\b",
}
INPUT_LIMIT = 5000
#: What an answer may not contain, and what it must mention.
OUTPUT_GUARD = r"(?i)\b(social\s+security\s+number|ssn)\b|\bcredit\s+card\s+number\b|\bpassword\b.*\b(is|:)\s*\S+"
CAVEATS = ("not medical advice", "consult", "clinical judgment", "demo data", "synthetic", "safety caveat", "not a substitute", "healthcare professional")


def _reasons(**flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in flags.items()]))


def input_reasons(question: Column) -> Column:
    """Why a question is refused; empty if it is safe."""
    hits = {name: question.rlike(pattern) for name, pattern in INPUT_GUARDS.items()}
    return _reasons(**hits, input_exceeds_safe_length=F.char_length(question) > INPUT_LIMIT)


def output_reasons(answer: Column, has_evidence: Column) -> Column:
    """What is wrong with an answer: unsafe content, emptiness, missing caveat or evidence."""
    empty = F.trim(answer) == ""
    caveat = answer.rlike("(?i)" + "|".join(CAVEATS))
    return _reasons(
        sensitive_data_in_output=answer.rlike(OUTPUT_GUARD),
        empty_answer=empty,
        missing_safety_caveat=~empty & ~caveat,
        no_evidence_available=~empty & ~has_evidence,
    )


def iso(moment: Column) -> Column:
    """[P18] A timestamp as ISO-8601 text, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def moment(text: Column) -> Column:
    """[P18] ISO-8601 text as a timestamp; null if it is none."""
    return F.try_to_timestamp(text)


def mapped(code: Column, table: dict[str, str], default: str) -> Column:
    """[P37] ``code`` by a fixed table, else ``default``."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, code), F.lit(default))


def json_cut(record: Column, limit: int = 4000) -> Column:
    """[P40] A record as JSON, cut to ``limit`` characters."""
    return F.left(F.to_json(record), F.lit(limit))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """[P38] ``part`` of ``whole``, rounded; 0 of nothing."""
    return F.round(F.when(whole != 0, part / whole).otherwise(0.0), digits)


def fingerprint(record: Column, fields: list[str]) -> Column:
    """[P28] SHA-256 of a record as canonical JSON: fields in sorted order, no spaces; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[record[f].alias(f) for f in sorted(fields)])), 256)
