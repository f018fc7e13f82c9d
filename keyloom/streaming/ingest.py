"""Streaming ingest: each micro-batch becomes changes, then a level-0 flush; replays of a batch are no-ops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.plans.engine import Engine


def start(changes: DataFrame, engine: Engine, order_by: str, checkpoint: str, name: str = "changes", **trigger) -> StreamingQuery:
    """Feed a stream of (key, type, value, order) into the engine. Arrival decides between batches, the order column inside one.

    Backpressure: a batch that meets a full level 0 waits in ``apply`` for compactions, so the stream waits.
    """

    def batch(df: DataFrame, number: int) -> None:
        engine.apply(df, order_by, stream=name, batch=number)
        engine.flush()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drain(changes: DataFrame, engine: Engine, order_by: str, name: str = "changes") -> None:
    """Process everything that is there, and compact until nothing is due."""
    query = start(changes, engine, order_by, f"{engine.path}/_streams/{name}-{uuid.uuid4().hex}", name)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    engine.compact_until_quiet()
