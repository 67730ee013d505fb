"""Spark session and shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    master: str = "local[*]", shuffle_partitions: int = 8, name: str = "probefleet", **settings: str
) -> SparkSession:
    """A session for tests and measurements; on a cluster the job's own settings apply."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small test data should still use all cores after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "8k")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session may run without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="probefleet-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def workers_find_library(spark: SparkSession) -> None:
    """Let Python workers that start without this repository on their path find the library."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
