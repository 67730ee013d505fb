"""Produced and consumed messages, matched on the stream.

A watermark join meets both sides while they are young, with its state in RocksDB. What reaches the join after its watermark
has passed is lost to it. So both sides also land as they come, counted by client and hour of creation; an hour in which the
join saw fewer messages or copies than landed is listed and matched again from the landed rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probefleet.operators import reconcile
from probefleet.operators.chunks import chunk_start
from probefleet.session import ROCKSDB, shared_folder
from probefleet.streaming import batches
from probefleet.streaming.clock import with_beats, without_beats
from probefleet.streaming.levels import Levels, sum_levels

HOUR_MS = 3600000
DAY_MS = 24 * HOUR_MS
_CLIENT = ("cluster_id", "client_id")
_SENT = ("cluster_id", "client_id", "partition", "message_id", "create_ms")
_BACK = ("cluster_id", "producer_id", "message_id", "timestamp", "recv_ms")


def match_stream(
    produced: DataFrame, decoded: DataFrame, delay: str, within: str, early: str, beats: DataFrame | None = None
) -> DataFrame:
    """Each produced message beside each of its copies, or beside null once none can come any more; and named heartbeats.

    A copy is received ``early`` before the message's creation at the earliest (clocks differ) and ``within`` after it at the
    latest. Either side may be ``delay`` behind the newest row.
    """
    produced.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    sent = with_beats(produced.select(*_SENT), beats, "create_ms", named=True)
    sent = sent.withColumn("sent_at", F.timestamp_millis("create_ms")).withWatermark("sent_at", delay)
    back = with_beats(decoded.select(*_BACK), beats, "recv_ms", named=True).withColumnRenamed("cluster_id", "back_cluster_id")
    back = back.withColumnRenamed("message_id", "back_message_id")
    back = back.withColumn("back_at", F.timestamp_millis("recv_ms")).withWatermark("back_at", delay)
    on = (
        (F.col("cluster_id") == F.col("back_cluster_id"))
        & (F.col("client_id") == F.col("producer_id"))
        & (F.col("message_id") == F.col("back_message_id"))
        & (F.col("create_ms") == F.col("timestamp"))
        & (F.col("back_at") >= F.col("sent_at") - F.expr(f"INTERVAL {early}"))
        & (F.col("back_at") <= F.col("sent_at") + F.expr(f"INTERVAL {within}"))
    )
    joined = sent.join(back, on, "leftOuter")
    return joined.select(*_SENT, "recv_ms")


def _hour(ms: str) -> Column:
    return chunk_start(F.col(ms), HOUR_MS).alias("hour_ms")


def hour_counts(folder: str) -> Levels:
    """Landed messages and copies by client and hour of creation."""
    sums = {"messages": "long", "copies": "long"}
    return sum_levels(folder, [*_CLIENT, "hour_ms"], ["string", "string", "long"], sums)


@dataclass
class Matching:
    """Two streams of one topic: the join, and the rows of both sides as they land, with their counts.

    Both go on where they ended when they are called again.
    """

    folder: str
    delay: str
    within: str
    early: str

    def join(self, produced: DataFrame, decoded: DataFrame, beats: DataFrame | None = None) -> None:
        """Pass what is available through the join."""
        rows = match_stream(produced, decoded, self.delay, self.within, self.early, beats)
        batches.run(batches.write_batches(rows, f"{self.folder}/joined", f"{self.folder}/checkpoint-join", without_beats))

    def land(self, produced: DataFrame, decoded: DataFrame) -> None:
        """Land what is available by side and day of creation; at a message's day its copies lie too."""
        nothing = F.lit(None)
        sent = produced.select(F.lit("sent").alias("side"), *_SENT, nothing.cast("bigint").alias("recv_ms"))
        back = decoded.select(
            F.lit("back").alias("side"), "cluster_id", F.col("producer_id").alias("client_id"), nothing.cast("int").alias("partition"),
            "message_id", F.col("timestamp").alias("create_ms"), "recv_ms",
        )
        rows = sent.unionByName(back).withColumn("day_ms", chunk_start(F.col("create_ms"), DAY_MS))
        counts = hour_counts(f"{self.folder}/counts")

        def write(batch: DataFrame, batch_id: int) -> None:
            path = f"{self.folder}/landed/batch_id={batch_id}"
            batch.write.mode("overwrite").partitionBy("side", "day_ms").parquet(path)
            landed = batch.sparkSession.read.schema(batch.schema).parquet(path)
            is_sent = (F.col("side") == "sent").cast("bigint")
            part = landed.select(*_CLIENT, _hour("create_ms"), is_sent.alias("messages"), (1 - is_sent).alias("copies"))
            counts.add(part, batch_id)

        batches.run(batches.start(rows, f"{self.folder}/checkpoint-land", write, "append", None))

    def _landed(self, spark: SparkSession, side: str) -> DataFrame:
        rows = spark.read.option("basePath", f"{self.folder}/landed").parquet(f"{self.folder}/landed/batch_id=*")
        return rows.where(F.col("side") == side).withColumn("hour_ms", _hour("create_ms"))

    def matched(self, spark: SparkSession) -> DataFrame:
        """The join's rows by message: copies and first arrival."""
        joined = spark.read.parquet(f"{self.folder}/joined/batch_id=*")
        messages = joined.groupBy(*_SENT).agg(F.count("recv_ms").alias("copies"), F.min("recv_ms").alias("first_recv_ms"))
        return messages.withColumn("hour_ms", _hour("create_ms"))

    def late(self, spark: SparkSession) -> DataFrame:
        """Hours whose messages or copies did not all pass through the join: (cluster_id, client_id, hour_ms, late_messages, late_copies).

        Copies of messages that never were produced count too.
        """
        seen = self.matched(spark).groupBy(*_CLIENT, "hour_ms").agg(
            (-F.count(F.lit(1))).alias("messages"), (-F.sum("copies")).alias("copies")
        )
        counts = hour_counts(f"{self.folder}/counts")
        gaps = counts.current(spark, counts.last(spark)).unionByName(seen).groupBy(*_CLIENT, "hour_ms").agg(
            F.sum("messages").alias("late_messages"), F.sum("copies").alias("late_copies")
        )
        return gaps.where("late_messages <> 0 or late_copies <> 0")

    def result(self, spark: SparkSession) -> DataFrame:
        """Every landed message with received, copies and first_recv_ms, as `reconcile.reconcile` gives it."""
        path = shared_folder(spark, "late-hours")
        self.late(spark).write.parquet(path)
        late = spark.read.parquet(path)
        keys = [*_CLIENT, "hour_ms"]
        young = self.matched(spark).join(late.select(*keys), keys, "left_anti")
        young = young.select(*_SENT, (F.col("copies") > 0).alias("received"), "copies", "first_recv_ms")
        days = late.select(chunk_start(F.col("hour_ms"), DAY_MS).alias("day_ms")).distinct()
        # Days first: they are folders, so only theirs are read.
        sent, back = (
            self._landed(spark, side).join(days, "day_ms", "left_semi").join(late.select(*keys), keys, "left_semi")
            for side in ("sent", "back")
        )
        back = back.withColumnsRenamed({"client_id": "producer_id", "create_ms": "timestamp"})
        return young.unionByName(reconcile.reconcile(sent.select(*_SENT), back.select(*_BACK)))
