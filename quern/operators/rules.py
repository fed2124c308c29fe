"""Declarative rules as joins, and lookups of reference data.

A rule pack is broadcast once its size is checked (``packed``), so the facts are not shuffled.  Lookups
(vocabularies, reactions, reference data) leave the choice of join to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import ALLERGENS


#: Rules that a pack may have to be broadcast; larger ones are joined as the optimizer sees fit.
MAX_RULES = 10_000


def packed(rules: DataFrame) -> DataFrame:
    """``rules``, to be broadcast if there are few; counting stops right after MAX_RULES."""
    return F.broadcast(rules) if rules.limit(MAX_RULES + 1).count() <= MAX_RULES else rules


def compared(value: Column, operator: Column, bound: Column) -> Column:
    """``value`` against ``bound`` by operator name; a missing operator is ``eq``, a wrong one an error."""
    name = F.coalesce(operator, F.lit("eq"))
    return (
        F.when(name == "gt", value > bound)
        .when(name == "gte", value >= bound)
        .when(name == "lt", value < bound)
        .when(name == "lte", value <= bound)
        .when(name == "eq", value == bound)
        .otherwise(F.raise_error(F.concat(F.lit("unknown operator "), name)).cast("boolean"))
    )


def threshold_signals(facts: DataFrame, rules: DataFrame, name: str, value: str, exact: bool = False, keep: bool = False) -> DataFrame:
    """[J05, F07] ``facts`` joined with every rule that fires: equal names, and the value compared.

    Names are compared without case; ``exact=True`` keeps the case.  Non-numeric values fire nothing.
    ``keep`` also returns facts that fire nothing, with nulls.
    """
    same = F.col(f"f.{name}") == F.col("r.observation") if exact else F.lower(F.col(f"f.{name}")) == F.lower(F.col("r.observation"))
    measured = F.col(f"f.{value}").try_cast("double")
    fires = same & compared(measured, F.col("r.operator"), F.col("r.bound"))
    return facts.alias("f").join(packed(rules).alias("r"), fires, "left" if keep else "inner").select("f.*", *[F.col(f"r.{c}").alias(c) for c in ("rule_id", "condition", "reason", "severity")])


def wildcard_signals(facts: DataFrame, rules: DataFrame, kind: str, code: str) -> DataFrame:
    """[J06, F08] ``facts`` joined with every rule whose type and code list match; null matches anything.

    A null code is in no list.  The rule table is a handful of rows, so a nested loop over it is right.
    """
    of_kind = F.col("r.claim_type").isNull() | (F.col("r.claim_type") == F.col(f"f.{kind}"))
    of_code = F.col("r.codes").isNull() | F.array_contains(F.col("r.codes"), F.col(f"f.{code}").cast("string"))
    fires = F.coalesce(of_kind & of_code, F.lit(False))
    return facts.alias("f").join(packed(rules).alias("r"), fires).select("f.*", *[F.col(f"r.{c}").alias(c) for c in ("rule_id", "outcome", "severity")])


def enriched(facts: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """[J01, J02] ``facts`` with a struct per dimension (null on a miss) and ``reference_hit_count``.

    ``dimensions``: name -> (dimension with one row per key, key in facts, key in the dimension).
    """
    out = facts
    for name, (dimension, fact_key, key) in dimensions.items():
        packed = dimension.select(F.col(key).alias(f"__{name}_key"), F.struct(*dimension.columns).alias(name))
        out = out.join(packed, F.col(fact_key) == F.col(f"__{name}_key"), "left").drop(f"__{name}_key")
    hits = sum((F.col(name).isNotNull().cast("int") for name in dimensions), F.lit(0))
    return out.withColumn("reference_hit_count", hits)


def standardised(facts: DataFrame, vocabulary: DataFrame, code: Column, family: str) -> DataFrame:
    """[J03] ``facts`` with ``standard`` struct<standard_system,display>, by folded code; null on a miss."""
    terms = vocabulary.where(F.col("family") == family).select(F.col("lookup").alias("__lookup"), F.struct("standard_system", "display").alias("standard"))
    return facts.join(terms, F.lower(F.trim(code)) == F.col("__lookup"), "left").drop(terms["__lookup"])


def adverse_matches(notes: DataFrame, orders: DataFrame, reactions: DataFrame) -> DataFrame:
    """[J14, M09] Notes whose symptom is a known reaction to a drug that the patient had ordered before.

    notes(note_id, patient_id, symptom, seq), orders(patient_id, medication, seq); one row per note and
    drug; ``severity`` and ``meddra_term`` are those of the first drug by name.
    """
    ordered = orders.groupBy("patient_id", "medication").agg(F.min("seq").alias("first_seq"))
    known = reactions.alias("k")
    told = notes.alias("n").join(known, F.lower("n.symptom") == F.lower("k.symptom"))
    met = told.join(ordered.alias("o"), (F.col("n.patient_id") == F.col("o.patient_id")) & (F.col("k.medication") == F.col("o.medication")) & (F.col("o.first_seq") < F.col("n.seq")))
    rows = met.select("n.note_id", "n.patient_id", "n.symptom", F.col("k.medication").alias("medication"), F.col("k.severity").alias("severity"), F.col("k.meddra_term").alias("meddra_term"))
    first = rows.groupBy("note_id").agg(F.min_by(F.struct("severity", "meddra_term"), "medication").alias("first"))
    return rows.drop("severity", "meddra_term").join(first, "note_id").select("note_id", "patient_id", "symptom", "medication", "first.severity", "first.meddra_term")


def allergy_matches(notes: DataFrame, medications: DataFrame, allergens: tuple[str, ...] = ALLERGENS) -> DataFrame:
    """[J15, M10] (note_id, medication): allergy notes (note_id, allergen) tied to the medication of that name.

    Only listed substances are tied, and only to medications that exist.
    """
    told = notes.where(F.col("allergen").isin(*allergens)).select("note_id", F.col("allergen").alias("medication"))
    return told.join(medications.select("medication").distinct(), "medication", "left_semi").select("note_id", "medication")


def signal_edges(fired: DataFrame, key: str) -> DataFrame:
    """[M05] One edge (src, dst, reason) per fact, condition and reason, with the last rule by id; none from none."""
    named = fired.where(F.col(key).isNotNull())
    return named.groupBy(F.col(key).cast("string").alias("src"), F.col("condition").alias("dst"), "reason").agg(F.max("rule_id").alias("rule_id"))


def abnormal(facts: DataFrame, limits: DataFrame, name: str, value: str) -> DataFrame:
    """[P36] ``facts`` with ``abnormal``: whether a value is outside its test's limits (name, low, high, closed); unknown tests are normal."""
    known = packed(limits.withColumnRenamed("name", "__name"))
    # A missing limit gives null, which is no reason by itself.
    reasons = F.coalesce(F.col(value) < F.col("low"), F.lit(False)) | F.coalesce(F.col(value) > F.col("high"), F.lit(False)) | F.coalesce(F.col("closed") & (F.col(value) == F.col("high")), F.lit(False))
    return facts.join(known, F.col(name) == F.col("__name"), "left").withColumn("abnormal", reasons).drop("__name", "low", "high", "closed")
