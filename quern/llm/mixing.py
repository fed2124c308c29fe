"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash and queued, up to three times over; a document's
virtual finish time is the source's tokens up to and with it, divided by the source's target.  The
queues are merged by a global range sort on that time and cut where the total budget is reached.

Prefix sums are taken in two levels (hash ranges of a source, then documents in a range), so a source
with a third of all documents is spread over every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, materialize, shuffle_width
from quern.operators.patterns import history

#: Default weights, dealt to the sources in order.
WEIGHTS = (5, 2, 1)
#: A source is read so often at most.
MAX_EPOCHS = 3
#: Repeats of a row that one task makes, and entries that one task looks through.
MANY_REPEATS = 10_000
FEW_ENTRIES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size), one row per source.

    The total is shared by weight; no target exceeds ``max_epochs`` times its source, and what is cut
    goes to the others by weight.  Sources take weights by code point order, null last.  Ranks and sums over
    the sources are taken in two levels (``history``), as there may be as many sources as web sites.
    """
    every = sizes.select("source", "source_size", F.col("source").isNull().alias("none"), F.lit(0).alias("all"))
    ranked = history(every, "all", ["none", "source"]).withColumnRenamed("step", "rank")
    cases = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    capped = ranked.withColumn("weight", cases.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = history(capped, "all", ["ratio", "rank"], size=F.col("cap")).withColumnsRenamed({"used": "caps", "step": "cap_rank"})
    weighed = materialize(history(filled, "all", ["ratio", "rank"], size=F.col("weight")).withColumnRenamed("used", "weights"))
    whole = F.broadcast(weighed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("heavy")))
    # The level of a source, were it the first that is not cut; the right one is the least that fits.
    levels = weighed.crossJoin(whole).withColumn("level", (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("heavy") - (F.col("weights") - F.col("weight"))))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("cap_rank", "level"))
    level = F.broadcast(levels.agg(F.min(fits)["level"].alias("right")))
    return levels.crossJoin(level).select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("right") * F.col("weight")).alias("target"))


def _each(rows: DataFrame, width: int) -> DataFrame:
    """``rows``, once for each of their ``repeats``, with ``nth``; many repeats are made by many tasks."""
    few = rows.where(F.col("repeats") <= MANY_REPEATS).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    many = rows.where(F.col("repeats") > MANY_REPEATS).withColumn("part", F.explode(F.expr(f"sequence(0, (repeats - 1) div {MANY_REPEATS})")))
    first = F.col("part") * MANY_REPEATS + 1
    many = many.repartition(width, "id", "text_hash", "part").withColumn("nth", F.explode(F.sequence(first, F.least(F.col("repeats"), first + (MANY_REPEATS - 1)))))
    return few.drop("repeats").unionByName(many.drop("part", "repeats"))


def _crossing(entries: DataFrame, order: list[str], budget: int, width: int):
    """The first entry, in ``order``, by which the tokens up to and with it reach ``budget``; None if none does.

    Entries are dealt to ranges, and the range that crosses is dealt again until it is small.
    """
    before = 0
    while True:
        ranged = materialize(entries.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()))
        # One number for each of the ranges.
        sums = ranged.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("part").collect()
        for part, tokens, n in sums:
            if before + tokens >= budget:
                break
            before += tokens
        else:
            return None
        entries = ranged.where(F.col("part") == part).drop("part")
        if n <= FEW_ENTRIES or len(sums) == 1:
            so_far = F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            return entries.withColumn("so_far", so_far + before).where(F.col("so_far") >= budget).orderBy(*order).first()


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(id, source, text_hash, nth, size, source_size, target, copies): one row per document.

    ``copies`` says how often the mix takes it, 0 to ``max_epochs``; the document that crosses the
    budget is still taken.  ``size`` counts words (null text: none).  Identical rows (id, source and text)
    are numbered by ``nth`` and queued one by one; a document without an id is shuffled by its text.  A null
    source is a source of its own.  Documents without a word are never taken.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    ranges = 4 * width
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(text).alias("text_hash"), size.alias("size"))
    slim = _each(slim.groupBy("id", "source", "text_hash", "size").agg(F.count("*").alias("repeats")), width)
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("#"), F.col("text_hash").cast("string")))
    shuffled = F.md5(F.when(F.col("nth") == 1, name).otherwise(F.concat_ws("#", name, F.col("nth").cast("string"))))
    hashed = slim.withColumn("hash", shuffled).withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    slim = materialize(hashed.withColumn("range", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")))

    by_range = slim.groupBy("queue", "source", "range").agg(F.sum("size").alias("tokens"))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("queue", "range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start")).join(targets, "queue")
    inside = Window.partitionBy("queue", "range").orderBy("hash", "id", "text_hash", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = materialize(slim.join(starts, ["queue", "range"]).withColumn("finish", F.col("start") + F.sum("size").over(inside)).drop("queue", "range", "start"))

    # Orders entries: virtual finish time, then source, round and shuffle order.
    times = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: (F.col("finish") + e * F.col("source_size")) / F.col("target"))
    timed = queued.withColumn("times", F.when((F.col("target") > 0) & (F.col("size") > 0), times))
    order = ["time", "rank", "round", "hash", "text_hash", "nth"]
    entries = timed.select("rank", "hash", "text_hash", "nth", F.col("size").alias("tokens"), F.posexplode("times").alias("round", "time"))
    budget = slim.agg(F.sum("size")).first()[0] or 0
    cut = _crossing(entries, order, budget, width) if budget else None
    if cut is None:
        copies = F.lit(0)
    else:
        last = F.struct(*[F.lit(cut[c]).cast(dict(entries.dtypes)[c]).alias(c) for c in order])
        entry = lambda t, e: F.struct(t.alias("time"), F.col("rank").alias("rank"), e.alias("round"), *[F.col(c).alias(c) for c in order[3:]])
        copies = F.size(F.filter(F.coalesce(F.col("times"), F.array().cast("array<double>")), lambda t, e: entry(t, e) <= last))
    return timed.select("id", "source", "text_hash", "nth", "size", "source_size", "target", copies.alias("copies"))
