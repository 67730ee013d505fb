"""Joins in time: the roster a check used, group joins that timed out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.operators.chunks import CHUNK, HOME, last_before, with_border

DAY_MS = 86400000


def roster_asof(checks: DataFrame, snapshots: DataFrame, width: int = DAY_MS) -> DataFrame:
    """Brokers that each check tried: (cluster_id, check_ms, broker_id).

    ``checks`` has (cluster_id, check_ms, expected_size). A check uses the newest snapshot up to its time.
    Where a size is expected, the first check that finds a snapshot of that size fixes the roster for this size from
    then on, so that brokers that are down are still tried. An optional column ``describe_failed`` marks checks
    that could not ask for the brokers: they try a fixed roster, or none.
    """
    sizes = snapshots.groupBy("cluster_id", "snapshot_ms").agg(F.count_distinct("broker_id").alias("_size"))
    nothing = F.lit(None).cast("bigint")
    failed = F.coalesce("describe_failed", F.lit(False)) if "describe_failed" in checks.columns else F.lit(False)
    # Snapshots are of kind 0, checks carry their expected size in the kind: 1 for any size. So a snapshot
    # comes before a check of the same time.
    timeline = sizes.select(
        "cluster_id", F.col("snapshot_ms").alias("at"), F.lit(0).cast("bigint").alias("_kind"),
        F.col("snapshot_ms").alias("_ms"), "_size",
    ).unionByName(
        checks.select(
            "cluster_id", F.col("check_ms").alias("at"),
            (F.col("expected_size") - C.DYNAMIC_SIZE + 1).cast("bigint").alias("_kind"),
            nothing.alias("_ms"), nothing.alias("_size"), failed.alias("_failed"),
        ), allowMissingColumns=True
    )
    found = (
        last_before(timeline, ["cluster_id"], "at", {"_seen_ms": "_ms", "_seen_size": "_size"}, width, ties=["_kind"])
        .where((F.col("_kind") > 0) & F.col("_seen_ms").isNotNull())
        .withColumn("expected_size", F.col("_kind") + C.DYNAMIC_SIZE - 1)
    )
    fits = (F.col("expected_size") != C.DYNAMIC_SIZE) & (F.col("expected_size") == F.col("_seen_size")) & ~F.col("_failed")
    fixed = (
        found.where(fits)
        .groupBy("cluster_id", "expected_size")
        .agg(F.min("at").alias("_from"), F.min_by("_seen_ms", "at").alias("_fixed_ms"))
    )
    used = F.when(
        (F.col("expected_size") != C.DYNAMIC_SIZE) & (F.col("at") >= F.col("_from")), F.col("_fixed_ms")
    ).when(~F.col("_failed"), F.col("_seen_ms"))
    chosen = found.join(fixed, ["cluster_id", "expected_size"], "left").select(
        "cluster_id", F.col("at").alias("check_ms"), used.alias("snapshot_ms")
    )
    members = snapshots.select("cluster_id", "snapshot_ms", "broker_id").distinct()
    return chosen.join(members, ["cluster_id", "snapshot_ms"]).select("cluster_id", "check_ms", "broker_id")


def join_attempts(events: DataFrame, timeout_ms: int = C.JOIN_TIMEOUT_MS) -> DataFrame:
    """Each start of a group join, and whether a ready signal followed in time."""
    keys = ["cluster_id", "client_id", "attempt"]
    within = W.partitionBy(*keys, CHUNK).orderBy("ts_ms").rangeBetween(0, timeout_ms)
    ready = F.max(F.when(F.col("kind") == "ready", True)).over(within)
    return (
        with_border(events, "ts_ms", width=timeout_ms * 1024, ahead=timeout_ms)
        .select(*keys, "kind", "ts_ms", HOME, F.coalesce(ready, F.lit(False)).alias("joined"))
        .where(F.col(HOME) & (F.col("kind") == "start"))
        .select(*keys, F.col("ts_ms").alias("start_ms"), "joined")
    )


def join_timeouts(events: DataFrame, timeout_ms: int = C.JOIN_TIMEOUT_MS) -> DataFrame:
    """Attempts and timeouts of each client; clients without a timeout have no counter yet, here 0."""
    return (
        join_attempts(events, timeout_ms)
        .groupBy("cluster_id", "client_id")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("joined")).alias("timeouts"))
    )
