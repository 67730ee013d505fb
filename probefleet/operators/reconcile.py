"""Which produced messages came back?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("cluster_id", "producer_id", "message_id", "timestamp")


def arrivals(decoded: DataFrame) -> DataFrame:
    """Copies received and first arrival of each message.

    Counted before the join, so that a message redelivered without end is one row on its way there.
    """
    return decoded.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("recv_ms").alias("first_recv_ms"))


def reconcile(produced: DataFrame, decoded: DataFrame) -> DataFrame:
    """Every produced message with the copies received.

    Message numbers restart with the producer process, so the creation time belongs to the key; equal client ids of
    other clusters are other clients.
    """
    back = arrivals(decoded)
    on = (
        (produced["cluster_id"] == back["cluster_id"])
        & (produced["client_id"] == back["producer_id"])
        & (produced["message_id"] == back["message_id"])
        & (produced["create_ms"] == back["timestamp"])
    )
    return produced.join(back, on, "left").select(
        *[produced[c] for c in produced.columns],
        back["copies"].isNotNull().alias("received"),
        F.coalesce(back["copies"], F.lit(0)).alias("copies"),
        back["first_recv_ms"],
    )


def lost(produced: DataFrame, decoded: DataFrame) -> DataFrame:
    """Produced messages of which no copy came back."""
    back = decoded.select(*KEY).distinct()
    on = (
        (produced["cluster_id"] == back["cluster_id"])
        & (produced["client_id"] == back["producer_id"])
        & (produced["message_id"] == back["message_id"])
        & (produced["create_ms"] == back["timestamp"])
    )
    return produced.join(back, on, "left_anti")
