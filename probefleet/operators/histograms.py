"""Latency histograms with cumulative buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet.functions.numbers import bound_text


def check_bounds(bounds: Sequence[float]) -> list[float]:
    bounds = [float(b) for b in bounds]
    if not bounds or any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("histogram bounds must ascend")
    return [b for b in bounds if b != float("inf")]


def bucket_counts(value: Column, bounds: Sequence[float]) -> list[Column]:
    """Aggregates: one count per bound, then sum and count; NULL is no observation."""
    counts = [F.count_if(value <= F.lit(b)).alias(f"_le_{i}") for i, b in enumerate(bounds)]
    return [*counts, F.sum(value).alias("sum"), F.count(value).alias("count")]


def long_buckets(wide: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """One row per bucket, ``+Inf`` last."""
    rows = [
        F.struct(F.lit(bound_text(b)).alias("le"), F.col(f"_le_{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return wide.select(*keys, F.inline(F.array(*rows)), "sum", "count").select(
        *keys, "le", "bucket_count", "sum", "count"
    )


def latency_histogram(df: DataFrame, value: str, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Histogram per key in one pass: the bounds are conditional counts, so rows are never multiplied."""
    bounds = check_bounds(bounds)
    wide = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*bucket_counts(F.col(value), bounds))
    return long_buckets(wide, keys, bounds)
