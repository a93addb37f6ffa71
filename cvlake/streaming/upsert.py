"""An extension: candidates kept up to date by a stream of parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cvlake.sources.store import sync


def start_upserts(changes: DataFrame, path: str, checkpoint: str, order: str = "synced_at") -> StreamingQuery:
    """Each micro-batch of candidate rows is merged into the table at path; the latest row of a file in a sector wins.

    Latest is by the column order, over all batches: a change that comes late doesn't replace a later one that is there. So the
    table is the same however changes are split into batches, and a batch that is run again changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        sync(batch.sparkSession, path, batch, order)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
