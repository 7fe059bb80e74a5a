"""Commit a stream of mutations to a versioned table, one batch for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lamina.plans.table import VersionedTable


def ingest(mutations: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Commit what the stream ``(key, kind, value, seq)`` holds, then stop.

    The log keeps the micro-batch number with the rows, so a micro-batch that is retried after a failure is
    committed once. The checkpoint's path names the stream.
    """

    def commit(rows: DataFrame, epoch: int) -> None:
        if not rows.isEmpty():
            table.commit(rows, stream=checkpoint, epoch=epoch)

    return mutations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
