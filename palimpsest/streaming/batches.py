"""Histories from streams: each micro-batch is merged like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..table import ScdTable


def stream_into(stream: DataFrame, table: ScdTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that merges each micro-batch of ``stream`` into ``table``.

    A micro-batch that is run again after a failure merges rows that are stored already, which changes
    nothing, so the table ends up as if each row came once. Empty batches write no version.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.apply(batch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
