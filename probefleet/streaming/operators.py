"""Streaming forms of the operators.

Counters, histograms and tick counts are sums, so a micro-batch only contributes its own partial result, whatever order
records arrive in; parts add up to the batch result. Messages and group joins are matched over what has landed, so no
copy and no signal is too late to count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probefleet.operators.chunks import chunk_start
from probefleet.operators.histograms import bucket_counts, check_bounds, long_buckets
from probefleet.operators.status import (
    KEYS,
    accumulate,
    add_increments,
    ring_size,
    status_of_ring,
    status_window,
    tick_increments,
)

#: A tick row before all others: what a client counted before the ticks that are kept.
BEFORE = -(2**62)


def partial_counts(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One batch's part of a counter."""
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def merge_counts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("value").alias("value"))


def partial_histogram(
    batch: DataFrame, value: str, time: str, keys: Sequence[str], bounds: Sequence[float], window_ms: int
) -> DataFrame:
    """One batch's part of the histograms by time window."""
    window = chunk_start(F.col(time), window_ms).alias("window_ms")
    return (
        batch.where(F.col(value).isNotNull())
        .groupBy(*keys, window)
        .agg(*bucket_counts(F.col(value), check_bounds(bounds)))
    )


def add_histograms(partials: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Parts of equal keys and windows added up; the result is a part again."""
    columns = [f"_le_{i}" for i in range(len(check_bounds(bounds)))] + ["sum", "count"]
    return partials.groupBy(*keys).agg(*[F.sum(c).cast(partials.schema[c].dataType).alias(c) for c in columns])


def merge_histograms(partials: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Histograms by window from all parts."""
    bounds = check_bounds(bounds)
    columns = [f"_le_{i}" for i in range(len(bounds))] + ["sum", "count"]
    wide = partials.groupBy(*keys, "window_ms").agg(*[F.sum(c).alias(c) for c in columns])
    return long_buckets(wide, [*keys, "window_ms"], bounds)


def partial_ticks(produced: DataFrame, consumed: DataFrame, tick_ms: int) -> DataFrame:
    """One batch's part of the records per client and tick."""
    return tick_increments(produced, consumed, tick_ms)


def status_from_ticks(partials: DataFrame, window_ms: int, tick_ms: int) -> DataFrame:
    """Status at every tick from all parts."""
    increments = add_increments(partials.select(*KEYS, "tick", "produced", "consumed"))
    return status_window(accumulate(increments, tick_ms), window_ms, tick_ms)


def recent_ticks(parts: DataFrame, window_ms: int, tick_ms: int) -> DataFrame:
    """The ticks that a client's next status needs, and one row (tick BEFORE) for all that came earlier.

    A record that arrives late adds to its tick, or to the earlier ones.
    """
    sums = add_increments(parts)
    reach = ring_size(window_ms, tick_ms) * tick_ms
    last = F.max("tick").over(W.partitionBy(*KEYS))
    kept = F.when(F.col("tick") > last - reach, F.col("tick")).otherwise(F.lit(BEFORE))
    return add_increments(sums.withColumn("tick", kept))


def current_status(ticks: DataFrame, window_ms: int, tick_ms: int) -> DataFrame:
    """Each client's status at its newest tick, from the rows of ``recent_ticks``.

    The oldest sample of the window has counted its own tick and all before it, so the change since then is the sum of
    the later ticks of the window.
    """
    size = ring_size(window_ms, tick_ms)
    own = W.partitionBy(*KEYS)
    newest = F.max("tick").over(own)
    first = F.min(F.when(F.col("tick") != BEFORE, F.col("tick"))).over(own)
    more = F.max(F.col("tick") == BEFORE).over(own)
    held = ticks.select(
        *KEYS,
        "tick",
        "produced",
        "consumed",
        newest.alias("_newest"),
        F.when(more, F.lit(size)).otherwise(F.least((newest - first) / tick_ms + 1, F.lit(size))).cast("bigint").alias("count"),
    )
    later = F.col("tick") > F.col("_newest") - (F.col("count") - 1) * tick_ms
    none = F.lit(0).cast("bigint")
    ring = held.groupBy(*KEYS, F.col("_newest").alias("tick"), "count").agg(
        none.alias("produced_tail"),
        F.sum(F.when(later, F.col("produced")).otherwise(none)).alias("produced_head"),
        none.alias("consumed_tail"),
        F.sum(F.when(later, F.col("consumed")).otherwise(none)).alias("consumed_head"),
    )
    return status_of_ring(ring, tick_ms)
