"""Published results: metric text, status documents, topology actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet.operators.scrape import to_exposition, type_lines


def write_exposition(samples: DataFrame, path: str, prefix: str = "") -> None:
    """Text files in which a metric's lines stand together, its help and type first.

    Ranges are cut by the lines themselves, so a metric with many series spreads over several files in their order.
    """
    lines = type_lines(samples, prefix).withColumnRenamed("rank", "_rank").unionByName(
        to_exposition(samples, prefix).select(
            F.regexp_replace("name", r"_latency_(bucket|sum|count)$", "_latency").alias("name"),
            "line",
            F.lit(2).alias("_rank"),
        )
    )
    ordered = lines.repartitionByRange("name", "_rank", "line").sortWithinPartitions("name", "_rank", "line")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_status(status_json: DataFrame, path: str, mode: str = "append") -> None:
    status_json.write.mode(mode).parquet(path)


def write_actions(actions: DataFrame, path: str, mode: str = "append") -> None:
    """Actions for a person or a tool to apply, in files by step."""
    actions.write.mode(mode).partitionBy("step").parquet(path)
