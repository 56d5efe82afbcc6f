"""Feedback on streams: a node that reads its own output through a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def feedback(seed: DataFrame, body: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that reads ``folder`` as a stream and appends ``body`` of each batch to it; the seed is the first append.

    Each batch is a round. A loop ends when ``body`` returns no rows; with ``availableNow`` a call runs the rounds that are there, and the next call goes on."""
    spark = seed.sparkSession
    seed.write.mode("append").parquet(folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        out = body(batch)
        if not out.isEmpty():
            out.select(*seed.columns).write.mode("append").parquet(folder)

    stream = spark.readStream.schema(seed.schema).parquet(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
