"""Retry schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C

_NANOS_PER_MS = 1000000


def retry_schedule(targets: DataFrame) -> DataFrame:
    """Delays before each retry: (target, attempt, delay_ms, elapsed_ms, last_outcome).

    ``targets`` has (target, max_attempts, scale_ms, max_ms). The delay doubles up to its maximum. The
    attempts end by their number (``exceeded``) or when the delay in nanoseconds leaves 64 bits (``overflow``).
    """
    scale = F.when(F.col("scale_ms") > 0, F.col("scale_ms")).otherwise(F.lit(C.BACKOFF_SCALE_MS)).cast("bigint")
    ceiling = F.when(F.col("max_ms") > 0, F.col("max_ms")).otherwise(F.lit(C.BACKOFF_MAX_MS)).cast("bigint")
    doublings = F.lit(64) - F.length(F.bin(scale * F.lit(_NANOS_PER_MS)))
    attempts = F.least(F.col("max_attempts").cast("int"), doublings)
    delays = F.expr("transform(sequence(0, _attempts - 1), a -> least(shiftleft(_scale, a), _ceiling))")
    return (
        targets.select("target", "max_attempts", scale.alias("_scale"), ceiling.alias("_ceiling"), attempts.alias("_attempts"))
        .where(F.col("_attempts") > 0)
        .select("*", delays.alias("_delays"))
        .select("*", F.posexplode("_delays").alias("attempt", "delay_ms"))
        .select(
            "target",
            "attempt",
            "delay_ms",
            F.aggregate(
                F.slice("_delays", 1, F.col("attempt") + 1), F.lit(0).cast("bigint"), lambda total, d: total + d
            ).alias("elapsed_ms"),
            F.when(F.col("_attempts") < F.col("max_attempts"), "overflow").otherwise("exceeded").alias("last_outcome"),
        )
    )
