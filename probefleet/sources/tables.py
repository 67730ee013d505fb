"""Landed tables: snapshots, logs, scrapes, configuration files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probefleet import schemas


def read_broker_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.BROKER_SNAPSHOT).format(fmt).load(path)


def read_topic_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.TOPIC_PARTITION).format(fmt).load(path)


def topic_leaders(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("cluster_id", "topic", "partition_id", "leader")


def replica_rows(snapshots: DataFrame) -> DataFrame:
    """Replicas in long form; replica 0 is the preferred leader."""
    return snapshots.select(
        "cluster_id", "topic", "partition_id", F.posexplode("replicas").alias("replica_idx", "broker_id")
    )


def read_log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, value): one row per line of all files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths).select(F.input_file_name().alias("path"), "value")


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).select(F.input_file_name().alias("path"), "value")


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of scrape files that lie in folders ``scrape_ms=<time>``: (scrape_ms, value)."""
    return spark.read.schema("value STRING, scrape_ms BIGINT").format("text").load(path).select("scrape_ms", "value")


def read_config_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files in folders ``poll_ms=<time>``, as rows of the snapshot table; the path is the file's name."""
    return (
        spark.read.schema("value STRING, poll_ms BIGINT")
        .format("text")
        .option("wholetext", True)
        .load(path)
        .select(
            F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path"),
            "poll_ms",
            F.lit(True).alias("exists"),
            F.col("value").alias("content"),
        )
    )


def with_absences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Add a row with ``exists`` false for each poll of ``expected`` (path, poll_ms) that found no file."""
    missing = expected.join(found, ["path", "poll_ms"], "left_anti")
    return found.unionByName(
        missing.select(
            "path", "poll_ms", F.lit(False).alias("exists"), F.lit(None).cast("string").alias("content")
        )
    )


def read_environments(spark: SparkSession, path: str) -> DataFrame:
    """Environment files in folders ``client_id=<id>``, lines ``KEY=value``, as rows (client_id, key, value)."""
    lines = spark.read.schema("value STRING, client_id STRING").format("text").load(path)
    at = F.instr("value", "=")
    return lines.where((at > 1) & ~F.col("value").startswith("#")).select(
        "client_id",
        F.col("value").substr(F.lit(1), at - 1).alias("key"),
        F.col("value").substr(at + 1, F.length("value")).alias("value"),
    )
