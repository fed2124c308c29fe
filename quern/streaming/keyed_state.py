"""Keyed state of a stream in the state store: reference versions, first sightings and steps of each key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The provider that typed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a key's row of a stream has, and what comes of an event of it.
ROW = "key string, seq long, is_reference boolean, known string"
ENRICHED = "key string, seq long, known string, first_seq long, step long"


class Keyed(StatefulProcessor):
    """[T03, T04, W03, W05] Events of a key with the reference value before them, the first event's place and their step.

    A reference row takes effect for the events that arrive after it, in its own batch or later ones; an event is
    never changed afterwards.  With ``ttl_ms`` the reference value is forgotten so long after it was written.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reference = handle.getValueState("reference", "known string", self.ttl_ms)
        self.steps = handle.getValueState("steps", "first_seq long, step long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        known, (first, step) = (self.reference.get() or (None,))[0], self.steps.get() or (None, 0)
        changed, before = False, step
        # One key's rows of one micro-batch, in the order of arrival.
        for row in sorted(rows, key=lambda r: r.seq):
            if row.is_reference:
                known, changed = row.known, True
            else:
                first, step = row.seq if first is None else first, step + 1
                yield Row(key=key[0], seq=row.seq, known=known, first_seq=first, step=step)
        if changed:
            self.reference.update((known,))
        if step > before:
            self.steps.update((first, step))

    def close(self) -> None:
        pass


def enriched(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of ROW as ENRICHED, by state that survives batches and restarts; rows without a key are left out.

    The state of a key is two small values, however many rows it has.
    """
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.where("key is not null").groupBy("key").transformWithState(Keyed(ttl_ms), ENRICHED, "Append", mode)
