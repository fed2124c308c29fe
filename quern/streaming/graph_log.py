"""The property graph as the state of a stream: what each micro-batch adds, merged when it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators import graph

#: Items of a step are numbered from a multiple of this, so that a later step's writes of an event come after an earlier's.
STEP_ITEMS = 1_000


class GraphLog:
    """[S10, M01, M02, T05] Steps of write programs (base, reference, typed), appended as partials by batch.

    A batch folds its own writes first, map-side for the most part: an identity, however hot, adds one row to a batch
    (one for each property, if an item of a program writes a property twice).  A batch is read once for all steps and
    has a folder of its own, which a replay writes again; a step that is replayed singly lies beside it and says the
    same again.  Nothing that is there is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, steps: dict[str, tuple], order: str = "arrival_seq"):
        self.spark, self.path, self.steps, self.order = spark, path.rstrip("/"), steps, order
        self.numbered = {step: place * STEP_ITEMS for place, step in enumerate(steps)}
        sides = graph.Sides({self.numbered[step]: program for step, program in steps.items()})
        self.form = sides if sides.fit else graph

    def apply(self, batch: DataFrame, batch_id: int, only: str | None = None) -> None:
        """Append what ``batch`` writes, in all steps or one."""
        programs = {self.numbered[step]: program for step, program in self.steps.items() if only in (None, step)}
        written = graph.writes_of(batch, programs, self.order)
        self.form.partials(written).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}/step={only or 'all'}")

    def sinks(self) -> list[Callable[[DataFrame, int], None]]:
        """A sink for each step, in order, for ``ingest``; ``apply`` is one for all."""
        return [lambda batch, batch_id, step=step: self.apply(batch, batch_id, step) for step in self.steps]

    def partials(self) -> DataFrame:
        return self.form.merged(self.spark.read.parquet(self.path).drop("batch", "step"))

    def read(self) -> DataFrame:
        """The graph, folded: see ``graph.folded``."""
        return self.form.finished(self.partials())

    def compacted(self, path: str, batch_id: int) -> GraphLog:
        """The state as the batch ``batch_id`` of a log of its own; later batches go there."""
        self.partials().write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}/step=all")
        return GraphLog(self.spark, path, self.steps, self.order)
