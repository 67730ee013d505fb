"""An outbox of topology actions: each run publishes what changed since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOPIC = ["cluster_id", "topic"]
_KEY = [*_TOPIC, "partition_id"]
_CONTENT = ["step", "action", "replicas"]
STATE = "cluster_id STRING, topic STRING, partition_id BIGINT, step INT, action STRING, replicas STRING, hash BIGINT, version BIGINT"


def _state(spark: SparkSession, folder: str, run: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{folder}/state/run={run}") if run >= 0 else spark.createDataFrame([], STATE)


def publish_actions(actions: DataFrame, folder: str, run: int) -> DataFrame:
    """Publish the difference between the actions and those of run ``run - 1``; the rows published.

    ``actions`` has one row for each (cluster_id, topic, partition_id). New and changed ones are published as ``issue``, those
    that hold no longer as ``withdraw``. A topic's version grows with each run that changes any of its actions. Equal runs
    publish nothing. State and publication of a run are folders of its own, so a run that is repeated replaces them.
    """
    spark = actions.sparkSession
    now = actions.select(
        *_TOPIC, F.col("partition_id").cast("bigint").alias("partition_id"), F.col("step").cast("int").alias("step"), "action", "replicas",
        F.xxhash64(*_CONTENT).alias("hash"),
    )
    before = _state(spark, folder, run - 1)
    marks = [F.bit_xor("hash").alias("mark"), F.count(F.lit(1)).alias("size")]
    old = before.groupBy(*_TOPIC).agg(*marks, F.max("version").alias("version"))
    old = old.withColumnsRenamed({"mark": "old_mark", "size": "old_size", "version": "old_version"})
    versions = now.groupBy(*_TOPIC).agg(*marks).join(old, _TOPIC, "full")
    same = F.col("mark").eqNullSafe(F.col("old_mark")) & F.col("size").eqNullSafe(F.col("old_size"))
    versions = versions.select(*_TOPIC, (F.coalesce("old_version", F.lit(0)) + F.when(same, 0).otherwise(1)).alias("version"))
    now.join(versions, _TOPIC).select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{folder}/state/run={run}")
    # From here on both sides are tables.
    after, was = _state(spark, folder, run), before.select(*_KEY, *[F.col(c).alias(f"old_{c}") for c in (*_CONTENT, "hash")])
    gone = F.col("hash").isNull()
    changed = (
        after.join(was, _KEY, "full")
        .where(~F.col("hash").eqNullSafe(F.col("old_hash")))
        .drop("version")
        .join(versions, _TOPIC)
        .select(
            *_KEY,
            F.when(gone, "withdraw").otherwise("issue").alias("change"),
            *[F.when(gone, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in _CONTENT],
            "version",
        )
    )
    path = f"{folder}/published/run={run}"
    changed.write.mode("overwrite").parquet(path)
    return spark.read.schema(changed.schema).parquet(path)
