"""Streams of writes into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.errors import LogDisabled
from siltstone.table import KVTable


def stream_into(source: DataFrame, table: KVTable, checkpoint: str, order_by: str | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch is one put; without a trigger all that is there is read and the query ends.

    A batch that a restart repeats is written once: it is named by the checkpoint and its number, and the table's log knows
    the names. With a column ``seq`` rows may come late; they win over older versions and lose to newer ones. The table needs
    its log, since what only a writer's memory holds would be lost with it.
    """
    if not table.opts.wal:
        raise LogDisabled

    def put(batch: DataFrame, number: int) -> None:
        table.put(batch, order_by=order_by, late=True, token=f"{checkpoint.rstrip('/')}/{number}")

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
