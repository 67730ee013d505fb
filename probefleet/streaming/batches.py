"""Streams into tables, one folder per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from probefleet.constants import TRIGGERS


def trigger(job: str | None = None) -> dict:
    """When a streaming query runs: the interval of a periodic job, or once over all that is available."""
    return {"processingTime": TRIGGERS[job]} if job else {"availableNow": True}


def write_batches(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each micro-batch to its own folder below ``table``.

    A batch that runs again after a failure replaces its folder, so that every batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return start(stream, checkpoint, write, mode, trigger)


def merge_batches(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    publish: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep a current table: each micro-batch merges its part with the table as the batch before it left it.

    Batch n writes folder n from its own rows and folder n - 1, both fixed, so a batch that runs again writes the same.
    Only one folder is read at a time, however long the stream has been running; older ones can be removed.
    ``publish`` gets the new table and the batch's number.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part = prepare(batch)
        if batch_id:
            before = batch.sparkSession.read.schema(part.schema).parquet(f"{table}/batch_id={batch_id - 1}")
            part = before.unionByName(part)
        merge(part).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        if publish:
            publish(batch.sparkSession.read.parquet(f"{table}/batch_id={batch_id}"), batch_id)

    return start(stream, checkpoint, write, "append", trigger)


def start(stream: DataFrame, checkpoint: str, write, mode: str, when: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(when or trigger()))
        .start()
    )


def run(query: StreamingQuery) -> int:
    """Wait until everything available is processed; a failure surfaces here. The number of the last batch."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query.lastProgress["batchId"] if query.lastProgress else -1


def read_batches(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All batches with their ``batch_id``."""
    return spark.read.schema(f"{schema}, batch_id BIGINT").option("basePath", table).parquet(table)
