"""Structured Streaming into a store: every micro-batch that carries cells becomes one layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.store import ArrayStore


def ingest(stream: DataFrame, store: ArrayStore, name: str, checkpoint: str, order_by: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream of cells (d0, ..., v) into an array.

    A batch that is replayed after a failure writes the same cells again,
    which leaves the array as it was: region writes are idempotent.
    """

    def batch(cells: DataFrame, _: int) -> None:
        store.write_cells(name, cells, order_by)
        store.flush()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
