"""The JSON payload of a probe message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = "producerId STRING, messageId BIGINT, timestamp BIGINT, _bad STRING"


def encode_payload(producer_id: Column, message_id: Column, timestamp: Column) -> Column:
    """Payload text with a fixed key order; absent values are written as zero values."""
    return F.to_json(
        F.struct(
            F.coalesce(producer_id, F.lit("")).alias("producerId"),
            F.coalesce(message_id.cast("bigint"), F.lit(0)).alias("messageId"),
            F.coalesce(timestamp.cast("bigint"), F.lit(0)).alias("timestamp"),
        )
    )


def decode_payload(value: Column) -> Column:
    """Struct of the payload fields, zero values where the text does not parse."""
    parsed = F.from_json(value.cast("string"), _FIELDS, {"columnNameOfCorruptRecord": "_bad"})
    return F.struct(
        F.coalesce(parsed["producerId"], F.lit("")).alias("producer_id"),
        F.coalesce(parsed["messageId"], F.lit(0)).alias("message_id"),
        F.coalesce(parsed["timestamp"], F.lit(0)).alias("timestamp"),
        (parsed.isNull() | parsed["_bad"].isNotNull()).alias("is_malformed"),
    )
