"""Continuous upserts into an index with Structured Streaming. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index


def upsert_stream(items: DataFrame, index: Index, checkpoint: str, rejected: str | None = None, **trigger) -> StreamingQuery:
    """Append the valid rows of a stream (id, vec, payload) to the log of ``index``, batch by batch;
    invalid ones go to the folder ``rejected`` with their error, or are left out.

    A batch's rows carry its number, and a batch that the log already has is passed over, so that a
    restart writes nothing twice. Of rows of one id in a batch the order is that of ``ts`` if the
    stream has it; without it, that of the vector's hash.
    """
    order = "ts" if "ts" in items.columns else None

    def write(batch: DataFrame, number: int) -> None:
        checked = index.validated(batch).persist()
        try:
            if rejected is not None:
                checked.where("error is not null").write.mode("overwrite").json(f"{rejected}/batch={number}")
            index.append_batch(checked.where("error is null"), f"stream-{number}", order)
        finally:
            checked.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of a stream (ts, event_type, value): counts and sums by tumbling
    window, with rows that come ``late`` left out. An extension."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )
