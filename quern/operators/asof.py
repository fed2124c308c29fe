"""As-of lookup: each fact with the version of its key that was in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import materialize


def as_of(facts: DataFrame, versions: DataFrame, key: str, order: str, name: str = "version", inclusive: bool = False) -> DataFrame:
    """[J14, T04, J01] ``facts`` with ``name``: the last of ``versions`` by ``order`` with the same key before the fact.

    ``versions`` has ``key``, ``order`` and what is to be known, which becomes a struct; null where there is none yet,
    and for facts without a key.  A version in the same place as a fact counts if ``inclusive``.  Of versions in one
    place the largest counts.

    Facts and versions are sorted together by ranges of (key, order), and each range carries its last version on.
    A range begins inside one key at most, so what it takes over is one row; these rows are broadcast.  A key with
    most of the rows lies in many ranges.
    """
    known = F.struct(*[F.col(f"`{c}`") for c in versions.columns if c not in (key, order)])
    of = lambda rows, turn, row, version: rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").alias("o"), F.lit(turn).alias("turn"), row, version)
    told = of(versions, 0 if inclusive else 1, F.lit(None).cast(facts.selectExpr("struct(*) as r").schema["r"].dataType).alias("row"), known.alias("v"))
    asked = of(facts, 1 if inclusive else 0, F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("row"), F.lit(None).cast(versions.select(known.alias("v")).schema["v"].dataType).alias("v"))
    rows = told.where("k is not null and o is not null").unionByName(asked.where("k is not null and o is not null"))
    # A fact must not be parted from the versions in its place that count.
    ranged = materialize(rows.repartitionByRange("k", "o", "turn").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("k", "range").orderBy("o", "turn", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranged.where("v is not null").groupBy("k", "range").agg(F.max_by("v", F.struct("o", "v")).alias("v"))
    spans = ranged.groupBy("k").agg(F.min("range").alias("low"), F.max("range").alias("high")).where("low < high")
    # Only keys in several ranges take anything over.
    places = ranged.select("k", "range").distinct().join(spans.select("k"), "k", "left_semi").join(ends, ["k", "range"], "left")
    before = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    taken = places.select("k", "range", F.last("v", True).over(before).alias("taken")).where("taken is not null")
    met = ranged.withColumn("here", F.last("v", True).over(inside)).where("row is not null").join(F.broadcast(taken), ["k", "range"], "left")
    columns = [F.col(f"row.`{c}`").alias(c) for c in facts.columns]
    found = met.select(*columns, F.coalesce("here", "taken").alias(name))
    lost = facts.where(F.col(f"`{key}`").isNull() | F.col(f"`{order}`").isNull())
    return found.unionByName(lost, allowMissingColumns=True)
