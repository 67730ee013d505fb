"""Latencies of single probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet.functions.payload import decode_payload


def with_produce_latency(attempts: DataFrame) -> DataFrame:
    """Acknowledged minus created; NULL for a failed attempt."""
    return attempts.withColumn("latency_ms", F.when(F.col("error").isNull(), F.col("ack_ms") - F.col("create_ms")))


def decode_records(records: DataFrame) -> DataFrame:
    """Add the payload's fields."""
    return records.withColumn("_payload", decode_payload(F.col("value"))).select(
        *records.columns,
        "_payload.producer_id",
        "_payload.message_id",
        "_payload.timestamp",
        "_payload.is_malformed",
    )


def with_e2e_latency(decoded: DataFrame) -> DataFrame:
    """Received minus created by the payload; may be negative when clocks differ."""
    return decoded.withColumn("latency_ms", F.col("recv_ms") - F.col("timestamp"))
