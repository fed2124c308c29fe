"""Scores of answers, and coverage of terminologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import CAVEATS, squeeze
from quern.operators.evidence import confidence


def linear_score(value: Column, best: float, worst: float) -> Column:
    """[P32] 1 up to ``best``, 0 from ``worst``, linear between."""
    return F.when(value <= best, 1.0).when(value >= worst, 0.0).otherwise(1 - (value - best) / (worst - best))


def routing_score(expected: Column, actual: Column) -> Column:
    """[P33] 1 if the request was routed as expected."""
    return F.coalesce(expected == actual, F.lit(False)).cast("double")


def coverage_score(expected: Column, found: Column) -> Column:
    """[P33] Share of the expected names that were found; 0 if none is expected."""
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda e: F.array_contains(found, e))) / F.size(expected)).otherwise(0.0)


def completeness_score(has_hits: Column, has_graph: Column) -> Column:
    """[P33] 1 if both channels gave evidence, a half if one did."""
    return confidence(has_hits, has_graph)


def quality_score(answer: Column) -> Column:
    """[P33] 0 for no answer or an error, a half for one of odd length, 1 for one of 51 to 4999 characters."""
    answer = F.coalesce(answer, F.lit(""))
    usable = (squeeze(answer).isNotNull()) & ~answer.startswith("LLM error:")
    return F.when(~usable, 0.0).when((F.char_length(answer) > 50) & (F.char_length(answer) < 5000), 1.0).otherwise(0.5)


def caveat_score(answer: Column) -> Column:
    """[P33] 1 if the answer has a safety caveat."""
    lower = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(lower.rlike("|".join(CAVEATS)), 1.0).otherwise(0.0)


def means(cases: DataFrame, scores: list[str]) -> DataFrame:
    """[A17, Q23] Mean of every score, to four places, and the number of cases."""
    return cases.agg(*[F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias(s) for s in scores], F.count("*").alias("cases"))


def compared(cases: DataFrame, mode: str, scores: list[str]) -> DataFrame:
    """[Q23] The means by mode of running."""
    return cases.groupBy(mode).agg(*[F.round(F.avg(s), 4).alias(s) for s in scores], F.count("*").alias("cases"))


def coverage(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """[A18] (coverage, terms): share of the distinct terms in use that a mapping knows."""
    marked = known.select(key).distinct().withColumn("known", F.lit(1.0))
    return used.select(key).distinct().join(marked, key, "left").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))), 4).alias("coverage"), F.count("*").alias("terms"))
