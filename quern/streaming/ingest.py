"""Streaming ingest: micro-batches appended to a log of writes, folded when it is read.

A sink is idempotent by batch: a batch writes the folder of its own id, and a replayed batch writes the same
folder again, so delivery is effectively once.  Nothing that is there is rewritten; a log that has grown long
is folded into a new one by ``compacted``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.functions.vectors import DIMENSION
from quern.operators import upsert
from quern.sources.shared import new_folder, shuffle_width


class WriteLog:
    """[S08, U02, T05] Writes by key as Parquet folders batch=<id>; the last write by ``order`` is a key's state.

    A batch is folded by itself first (map-side for the most part), so a hot key adds a row to each batch.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, values: list[str]):
        self.spark, self.path, self.keys, self.order, self.values = spark, path.rstrip("/"), keys, order, values

    def _folded(self, rows: DataFrame, order: str) -> DataFrame:
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(F.col(order).alias("__order"), *self.values)).alias("last"))
        return last.select(*self.keys, F.col("last.__order").alias("__order"), *[F.col(f"last.{v}").alias(v) for v in self.values])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self._folded(batch, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        """(keys, __order, values): the state that all batches leave."""
        return self._folded(self.spark.read.parquet(self.path).drop("batch"), "__order")

    def compacted(self, path: str, batch_id: int) -> WriteLog:
        """The state as the batch ``batch_id`` of a log of its own; later batches go there."""
        self.read().write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
        return WriteLog(self.spark, path, self.keys, self.order, self.values)


class Collection(WriteLog):
    """[S08, S09] Points of a vector table by ``point_id``; made if it is not there, else it must be alike.

    Its dimension and metric lie beside it; points of another dimension are an error.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int = DIMENSION, metric: str = "cosine"):
        super().__init__(spark, f"{path.rstrip('/')}/points", ["point_id"], "arrival_seq", ["embedding", "payload"])
        about, wanted = f"{path.rstrip('/')}/about", (dimension, metric)
        at = spark._jvm.org.apache.hadoop.fs.Path(about)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found = tuple(spark.read.schema("dimension int, metric string").json(about).first())
            if found != wanted:
                raise ValueError(f"the collection has {found}, not {wanted}")
        else:
            spark.createDataFrame([wanted], "dimension int, metric string").coalesce(1).write.json(about)
        self.dimension = dimension

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Add points (point_id, arrival_seq, embedding, payload)."""
        fits = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a point has not {self.dimension} components")))
        super().apply(batch.withColumn("embedding", fits), batch_id)


#: Rows of a go for each partition of a stream's state, about.
STATE_ROWS = 100_000


@contextmanager
def _in_force(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` of the session for a while; a stream that starts meanwhile keeps them."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_settings(rows: DataFrame, batches: int, joins: bool = False) -> dict[str, str]:
    """What a stream of ``rows`` in so many goes that keeps state by key is to start with.

    A partition of the state commits the files of each of its stores (four for a join) in every micro-batch, however few
    rows it holds, so partitions follow the rows of a go and not the session's shuffles, of which they are never more.
    An inner join (``joins``) has no use for the batches without data that only move the watermark: what they would drop, the next
    batch does.
    """
    spark = rows.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, -(-rows.count() // (batches * STATE_ROWS)))
    settings = {"spark.sql.shuffle.partitions": str(min(shuffle_width(spark), wanted))}
    return settings | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if joins else {})


def ingest(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None, settings: dict[str, str] | None = None):
    """[S02, S10, T05] Start a query that gives every micro-batch to all sinks; ``every``: a trigger interval.

    Without an interval it takes what is there and stops.  ``settings`` of the session hold for this query alone.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        for sink in sinks:
            sink(batch, batch_id)

    writer = stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    with _in_force(stream.sparkSession, settings or {}):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def references_first(batch: DataFrame, apply_reference: Callable[[DataFrame], None], apply_events: Callable[[DataFrame], None]) -> None:
    """[T04] Reference rows of a batch become visible before its events are enriched."""
    apply_reference(batch.where("route = 'reference'"))
    apply_events(batch.where("route = 'event'"))


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """[T01, T02] Extension: counts by event-time window, late rows up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def first_sightings(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """[T11] Extension: each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def interval_joined(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: str, late: str = "10 minutes") -> DataFrame:
    """[T08, J14, T11] Rows of ``right`` with those of ``left`` that came up to ``within`` before them, by equal keys.

    Of two streams both sides are kept as state only as long as the watermarks (``late``) and the interval allow
    a partner; of two tables the same rows come out.  Other columns must have different names; the keys are
    ``right``'s.
    """
    earlier = left.withColumnsRenamed({k: f"__{k}" for k in keys}).withWatermark(left_ts, late)
    later = right.withWatermark(right_ts, late)
    same = [F.col(f"__{k}") == F.col(k) for k in keys]
    near = (F.col(left_ts) < F.col(right_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return later.join(earlier, reduce(lambda a, b: a & b, same, near)).drop(*[f"__{k}" for k in keys])


def console(stream: DataFrame, rows: int = 20):
    """[S07] Start a query that shows what arrives."""
    return stream.writeStream.format("console").option("numRows", rows).trigger(availableNow=True).start()


def corrected(events: DataFrame, apply: bool = False) -> DataFrame:
    """[T07, K16] Events with their correction columns; ``apply`` is an extension that drops what was corrected."""
    if not apply:
        return events
    replaced = events.where("is_correction").select(F.col("correction_of_event_id").alias("event_id")).where("event_id is not null")
    return events.join(replaced.distinct(), "event_id", "left_anti")


def replay_latest(spark: SparkSession, path: str, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """[T03, T05] A Parquet source replayed as a stream into a log of writes; the state that results."""
    root = new_folder(spark, "replay")
    sink = WriteLog(spark, f"{root}/log", keys, order, values)
    ingest(replayed(spark, path), [sink.apply], f"{root}/checkpoint").awaitTermination()
    return upsert.latest(sink.read(), keys, "__order", values)


def replayed(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """[S01] A Parquet table (a folder, or a single file of one) as a stream of its files; ``files`` at most a batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def fed(spark: SparkSession, rows: DataFrame, order: str, batches: int, start: Callable[[DataFrame], StreamingQuery]) -> list[dict]:
    """[S01, S02, T05] ``rows`` come to a stream in so many goes, dealt out by ranges of the number ``order``, lowest first.

    ``start`` starts the query, which takes what is there and stops; it goes on from its checkpoint in the next
    go.  Returns the progress of each query's micro-batches.
    """
    folder = new_folder(spark, "fed")
    bounds = rows.approxQuantile(order, [i / batches for i in range(1, batches)], 0.001)
    place, progress = F.col(order), []
    for n, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        inside = (F.lit(True) if low is None else place > low) & (F.lit(True) if high is None else place <= high)
        # A range of a sorted table lies in one part of it: a go that is not dealt out anew is one file, and so one task.
        rows.where(inside).repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/go={n}")
        run = start(spark.readStream.schema(rows.schema).parquet(folder))
        run.awaitTermination()
        progress += [json.loads(p.json) for p in run.recentProgress]
    return progress
