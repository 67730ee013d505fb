"""Heartbeats: rows that carry nothing but a time and move a stream's watermark on where the probes are silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEAT = "at_ms BIGINT"


def beat(spark: SparkSession, folder: str, at_ms: int) -> None:
    """Land one heartbeat: nothing earlier is still to come."""
    spark.createDataFrame([(at_ms,)], BEAT).coalesce(1).write.mode("append").parquet(folder)


def landed_beats(spark: SparkSession, folder: str) -> DataFrame:
    """The heartbeats that land in a folder, as a stream; the folder must exist."""
    return spark.readStream.schema(BEAT).parquet(folder)


def live_beats(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """The time itself as a stream of heartbeats, for live sources."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.unix_millis("timestamp").alias("at_ms"))


#: Stands for the names in a heartbeat where Spark would take rows with nulls away before they move the watermark.
NAME = "\x00beat"


def with_beats(stream: DataFrame, beats: DataFrame | None, time: str, named: bool = False) -> DataFrame:
    """The stream's rows, and heartbeats as rows of which all columns but the time are null (or NAME and -1 where ``named``)."""
    if beats is None:
        return stream

    def blank(kind: str) -> Column:
        value = (NAME if kind == "string" else -1) if named else None
        return F.lit(value).cast(kind)

    columns = [(F.col("at_ms") if name == time else blank(kind)).alias(name) for name, kind in stream.dtypes]
    return stream.unionByName(beats.select(*columns))


def without_beats(rows: DataFrame) -> DataFrame:
    """The rows of a micro-batch that are no named heartbeats; asked of the stream itself, Spark would filter before the watermark."""
    return rows.where(F.col("cluster_id") != NAME)
