"""The probe topic itself. Needs Spark's Kafka connector on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_probe_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """All partitions of the topic as a stream; the query's checkpoint takes the place of group offsets."""
    options = {"startingOffsets": "latest", **options}
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )


#: The record's timestamp is the broker's, set on arrival.
LOG_APPEND_TIME = 1


def consume_records(kafka: DataFrame, cluster_id: str, client_id: str) -> DataFrame:
    """Records in the form of the consume table; recv_ms is the time at which the record is received.

    By default a topic keeps the time at which the producer made a record, which says nothing about its receipt. So
    only a time that the broker set on arrival is taken; of other records the receipt is the time of the query's
    micro-batch (of a batch job: its start).
    """
    arrived = F.when(F.col("timestampType") == LOG_APPEND_TIME, F.col("timestamp")).otherwise(F.current_timestamp())
    return kafka.select(
        F.lit(cluster_id).alias("cluster_id"),
        F.lit(client_id).alias("client_id"),
        "partition",
        "offset",
        F.col("value").cast("string").alias("value"),
        F.unix_millis(arrived).alias("recv_ms"),
        (F.col("timestampType") == LOG_APPEND_TIME).alias("recv_by_broker"),
    )


def probe_messages(round_df: DataFrame, topic: str) -> DataFrame:
    """A probe round in the columns of the sink: each message names its partition, none has a key."""
    return round_df.select(
        F.lit(topic).alias("topic"), F.col("partition").cast("int").alias("partition"), F.col("payload").alias("value")
    )


def _sink_options(servers: str, options: dict[str, str]) -> dict[str, str]:
    # Every replica must acknowledge, and a failed send stays failed.
    return {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.retries": "0", **options}


def write_probe_round(round_df: DataFrame, servers: str, topic: str, **options: str) -> None:
    probe_messages(round_df, topic).write.format("kafka").options(**_sink_options(servers, options)).save()


def write_probe_stream(
    round_df: DataFrame, servers: str, topic: str, checkpoint: str, interval: str = "30 seconds", **options: str
) -> StreamingQuery:
    return (
        probe_messages(round_df, topic)
        .writeStream.format("kafka")
        .options(**_sink_options(servers, options))
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
