"""Streams in several batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from probefleet import schemas
from probefleet.functions.payload import encode_payload
from probefleet.operators import histograms, latency, status
from probefleet.session import shared_folder
from probefleet.sources import probe_topic, sinks, tables
from probefleet.streaming import batches
from probefleet.streaming import operators as ops


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Kafka-shaped records in files that are far from time order."""
    folder = str(tmp_path_factory.mktemp("records"))
    rnd = random.Random(2)
    data = [(rnd.randrange(3), i, rnd.randrange(3 * 3600 * 1000), rnd.randrange(900)) for i in range(600)]
    df = spark.createDataFrame(data, "partition INT, offset BIGINT, sent BIGINT, lat BIGINT").select(
        F.lit(None).cast("binary").alias("key"),
        F.when(F.col("offset") % 50 == 0, F.lit("bad"))
        .otherwise(encode_payload(F.lit("x"), F.col("offset"), F.col("sent")))
        .cast("binary")
        .alias("value"),
        F.lit("probe").alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis(F.col("sent") + F.col("lat")).alias("timestamp"),
        F.lit(1).alias("timestampType"),
    )
    for part in range(4):
        df.where(F.col("offset") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    return folder


def records(source):
    return probe_topic.consume_records(source, "c", "x")


def source(spark, folder):
    return spark.readStream.schema(schemas.KAFKA_RECORD).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, stream, prepare=None, mode="append"):
    folder = shared_folder(spark, "test")
    batches.run(batches.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", prepare, mode))
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch_id=*")
    assert out.select("batch_id").distinct().count() > 1
    return out


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_counts(spark, landed):
    keys = ["client_id", "partition"]
    folder = shared_folder(spark, "counts")
    query = batches.merge_batches(
        records(source(spark, landed)), f"{folder}/out", f"{folder}/checkpoint",
        lambda batch: ops.partial_counts(batch, keys), lambda parts: ops.merge_counts(parts, keys),
    )
    last = batches.run(query)
    assert last == 3
    want = records(spark.read.parquet(landed)).groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))
    same(spark.read.parquet(f"{folder}/out/batch_id={last}"), want)


def e2e(df):
    return latency.with_e2e_latency(latency.decode_records(records(df)))


BOUNDS = [5, 100, 800]


def test_histograms_of_late_records(spark, landed):
    def prepare(batch):
        return ops.partial_histogram(batch, "latency_ms", "recv_ms", ["partition"], BOUNDS, 60000)

    parts = drained(spark, e2e(source(spark, landed)), prepare)
    rows = e2e(spark.read.parquet(landed)).withColumn("window_ms", F.col("recv_ms") - F.col("recv_ms") % 60000)
    same(ops.merge_histograms(parts, ["partition"], BOUNDS), histograms.latency_histogram(rows, "latency_ms", ["partition", "window_ms"], BOUNDS))


def test_status(spark, landed):
    def split(df):
        seen = latency.decode_records(records(df))
        sent = seen.select("cluster_id", "client_id", F.col("timestamp").alias("ack_ms"), F.lit(None).cast("bigint").alias("recv_ms"))
        return sent.unionByName(seen.select("cluster_id", "client_id", F.lit(None).cast("bigint").alias("ack_ms"), "recv_ms"))

    def prepare(batch):
        return ops.partial_ticks(batch.where("ack_ms IS NOT NULL"), batch.where("recv_ms IS NOT NULL"), 30000)

    ticks = drained(spark, split(source(spark, landed)), prepare)
    whole = split(spark.read.parquet(landed))
    samples = status.sample_counters(whole.where("ack_ms IS NOT NULL"), whole.where("recv_ms IS NOT NULL"), 30000)
    want = status.status_window(samples, 300000, 30000)
    same(ops.status_from_ticks(ticks, 300000, 30000), want)

    # The current status after each batch equals that of all records up to it, whatever order they came in.
    folder, parts = shared_folder(spark, "current"), {}

    def publish(current, batch_id):
        parts[batch_id] = sorted(map(tuple, ops.current_status(current, 300000, 30000).collect()))

    query = batches.merge_batches(
        split(source(spark, landed)), f"{folder}/out", f"{folder}/checkpoint", prepare,
        lambda p: ops.recent_ticks(p, 300000, 30000), publish,
    )
    last = batches.run(query)
    assert last > 1 and parts[last] == sorted(map(tuple, status.newest_status(want).collect()))


def test_a_batch_that_runs_again_counts_once(spark, landed):
    folder = shared_folder(spark, "again")
    stream = records(source(spark, landed))
    batches.run(batches.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint-1"))
    # A lost checkpoint replays the same batches over their folders.
    batches.run(batches.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint-2"))
    assert batches.read_batches(spark, f"{folder}/out", schemas.CONSUME_RECORD).count() == 600


def test_stream_on_a_timer(spark, landed):
    folder = shared_folder(spark, "timer")
    query = batches.write_batches(
        records(source(spark, landed)), f"{folder}/out", f"{folder}/checkpoint", trigger={"processingTime": "1 second"}
    )
    try:
        query.processAllAvailable()
        assert batches.read_batches(spark, f"{folder}/out", schemas.CONSUME_RECORD).count() == 600
        assert query.isActive
    finally:
        query.stop()


def test_stream_of_log_lines(spark, tmp_path):
    from probefleet.operators.logs import parse_log_lines

    (tmp_path / "a.log").write_text("I0101 producer.go:10] Message sent: duration=15 ms\nother\n")
    stream = parse_log_lines(tables.stream_log_lines(spark, str(tmp_path)))
    folder = shared_folder(spark, "logs")
    batches.run(batches.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint"))
    assert [(r.kind, r.duration_ms) for r in spark.read.parquet(f"{folder}/out").collect()] == [("producer", 15)]


def test_time_of_receipt(spark):
    made = "cast(null as binary) key, cast('x' as binary) value, 'p' topic, 0 partition, 5L offset"
    kafka = spark.sql(f"select {made}, timestamp_millis(1000) timestamp, kind timestampType from values (0), (1) as t(kind)")
    now = spark.sql("select unix_millis(current_timestamp())").first()[0]
    got = {r.recv_by_broker: r.recv_ms for r in probe_topic.consume_records(kafka, "c", "x").collect()}
    assert got[True] == 1000 and got[False] >= now


def test_triggers():
    assert batches.trigger("status") == {"processingTime": "30 seconds"} and batches.trigger() == {"availableNow": True}


def test_messages_name_topic_and_partition(rows):
    df = rows("client_id STRING, partition BIGINT, payload STRING", ("x", 2, "{}"))
    got = probe_topic.probe_messages(df, "probe")
    assert got.dtypes == [("topic", "string"), ("partition", "int"), ("value", "string")]
    assert tuple(got.first()) == ("probe", 2, "{}")


def test_sink_needs_all_replicas_and_does_not_retry():
    options = probe_topic._sink_options("b:9092", {"kafka.security.protocol": "SSL"})
    assert options == {
        "kafka.bootstrap.servers": "b:9092", "kafka.acks": "all", "kafka.retries": "0", "kafka.security.protocol": "SSL"
    }


def test_snapshot_tables(spark, tmp_path):
    path = str(tmp_path / "topics")
    row = ("c", "t", None, 0, 3, [3, 4], [3], [4])
    spark.createDataFrame([row], schemas.TOPIC_PARTITION).write.parquet(path)
    snapshots = tables.read_topic_snapshots(spark, path)
    assert tuple(tables.topic_leaders(snapshots).first()) == ("c", "t", 0, 3)
    assert [tuple(r) for r in tables.replica_rows(snapshots).collect()] == [("c", "t", 0, 0, 3), ("c", "t", 0, 1, 4)]


def test_broker_snapshots(spark, tmp_path):
    path = str(tmp_path / "brokers")
    spark.createDataFrame([("c", 1, 2, "r")], schemas.BROKER_SNAPSHOT).write.json(path)
    assert tuple(tables.read_broker_snapshots(spark, path, "json").first()) == ("c", 1, 2, "r")


def test_actions_and_status_tables(spark, rows, tmp_path):
    actions = rows(
        "cluster_id STRING, topic STRING, step INT, action STRING, partition_id BIGINT, replicas STRING",
        ("c", "t", 1, "reassign", 0, "1,2"), ("c", "t", 2, "create_partitions", 1, "2,1"),
    )
    sinks.write_actions(actions, str(tmp_path / "actions"))
    assert [r.action for r in spark.read.parquet(str(tmp_path / "actions")).where("step = 2").collect()] == ["create_partitions"]
    for tick in (1, 2):
        sinks.write_status(rows("cluster_id STRING, client_id STRING, tick BIGINT, json STRING", ("c", "x", tick, "{}")), str(tmp_path / "status"))
    assert spark.read.parquet(str(tmp_path / "status")).count() == 2


def test_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared_folder(Session, "x")
