"""Structured Streaming into a store, one committed segment per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelog.engine import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "changes", order: str | None = None, flush: bool = True, **trigger) -> StreamingQuery:
    """Starts a query that applies each micro-batch of (key, op, value) rows.

    The store remembers the last batch id of each stream in the same manifest version
    that adds the batch, so a batch that Spark runs again after a failure is skipped.
    `order` must grow over batches as within them only by key; the store's own counter
    puts a later batch after an earlier one. With `flush` each batch becomes a run.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.apply(batch, order, (name, batch_id)) and flush:
            store.flush()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
