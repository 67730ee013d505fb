"""Probe tables derived from the driver's tables. The oracle derives the same tables in SQL.

Each function takes DataFrames and adds narrow expressions, so that the probe tables grow with their input
and only the columns in use are read. Most work on streams too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.functions.payload import encode_payload

HOUR_MS = 3600000
DAY_MS = 24 * HOUR_MS
SILENT_CLIENT = "client-9"
EXPECTED_SIZE = 9
ROSTER_SIZE = 6
# In every so manieth hour the brokers cannot be asked for.
FAILED_EVERY = 5
SCRAPE_OFFSET_MS = 7000
# 2024-01-20
LAST_SCRAPE_MS = 1705708800000
# 2024-01-01
FIRST_MS = 1704067200000
# Times outside of these come from wrong clocks: a day before the first probe, two months after it.
CLOCK_FROM_MS, CLOCK_UNTIL_MS = FIRST_MS - 86400000, FIRST_MS + 60 * 86400000

# Configuration strings of the fleet: customer k uses the entry k modulo the number of entries.
CONFIG_CHOICES = {
    "KAFKA_BOOTSTRAP_SERVERS": ("kafka-broker-1:9092,kafka-broker-2:9092", None, "localhost:9092"),
    "TOPIC_CONFIG": (
        "retention.ms=600000;segment.bytes=16384;cleanup.policy=compact,delete",
        None,
        "=600000;segment.bytes=16384",
        "aaaaa;segment.bytes=16384",
        ";;;;segment.bytes=16384",
        "retention.ms=600000;",
        "a=1;b=;a=2",
        "a=1=2",
        "",
    ),
    "PROMETHEUS_CONSTANT_LABELS": ("site=one;team=two", None, "site=", "site", "site=one;site=two"),
    "PRODUCER_LATENCY_BUCKETS": ("400,800,1600,3200,6400", None, "2, 5", "1,x", "0.5,1e2,.5", "", "1,2,"),
    "ENDTOEND_LATENCY_BUCKETS": ("800,1600,3200,6400,12800", None, "5", "10d"),
    "CONNECTION_CHECK_LATENCY_BUCKETS": ("200,400,800", None),
    "EXPECTED_CLUSTER_SIZE": (None, "3", "three", "-1", "+5"),
    "VERBOSITY_LOG_LEVEL": (None, "1", "", "99999999999999999999"),
    "TLS_ENABLED": (None, "true", "T", "yes", "0", "TRUE", "1"),
    "TLS_CA_CERT": ("PEM", None, ""),
    "TLS_CLIENT_KEY": (None, "KEY"),
    "SASL_MECHANISM": (None, "PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512", "GSSAPI", ""),
    "SASL_USER": ("user", "user", "", None),
    "SASL_PASSWORD": ("password", None, "password", "password", "password"),
    "EXPORTER_TYPE_TRACING": (None, "otlp", "jaeger", "zipkin"),
}
BACKOFF_CHOICES = {
    "max_attempts": (6, 3, 10, 40, 1),
    "scale_ms": (200, 5000, 360000, 0, -5, 1, 250),
    "max_ms": (300000, 0, 60000),
}
ERROR_CLASSES = (*C.DISCONNECTIONS, "UNKNOWN", "INVALID_CONFIG")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: tuple, index: Column, kind: str = "string") -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def epoch_ms(column: str) -> Column:
    """Epoch milliseconds of a timestamp without a zone, read as UTC whatever the session's zone is."""
    at = F.col(column)
    millis = F.floor(F.extract(F.lit("SECOND"), at) * 1000).cast("bigint")
    return F.unix_date(at.cast("date")).cast("bigint") * DAY_MS + F.hour(at) * HOUR_MS + F.minute(at) * 60000 + millis


def probes(events: DataFrame) -> DataFrame:
    """The events as probes: cluster, client, partition, time and latency. Each client id occurs in both clusters."""
    client = F.pmod("user_id", F.lit(5))
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        _name("cluster-", F.pmod("user_id", F.lit(2))).alias("cluster_id"),
        _name("client-", client).alias("client_id"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("partition"),
        epoch_ms("ts").alias("ms"),
        F.floor("value").alias("lat"),
    )


def produce_attempts(probe: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return probe.select(
        "cluster_id",
        "client_id",
        "partition",
        F.col("event_id").alias("message_id"),
        F.col("ms").alias("create_ms"),
        (F.col("ms") + F.col("lat")).alias("ack_ms"),
        F.when(failed, F.lit(-1)).otherwise(F.col("event_id")).cast("bigint").alias("offset"),
        F.when(failed, "timeout").alias("error"),
    )


def consume_records(probe: DataFrame) -> DataFrame:
    """Failed sends and latencies of 40 to 41 ms never arrive; from 150 ms on a second copy does.

    At 20 ms the payload is cut short, and below 1 ms the receiving clock is behind.
    """
    lat = F.col("lat")
    payload = encode_payload(F.col("client_id"), F.col("event_id"), F.col("ms"))
    delay = F.when(lat < 1, F.lit(-3)).otherwise(2 * lat)
    copies = F.when(lat >= 150, F.array(F.lit(0), F.lit(1000))).otherwise(F.array(F.lit(0)))
    return (
        probe.where((F.col("event_type") != "error") & ~lat.between(40, 41))
        .select("*", F.explode(copies).alias("_again"))
        .select(
            "cluster_id",
            "client_id",
            "partition",
            F.col("event_id").alias("offset"),
            F.when(lat == 20, F.substring(payload, 1, 20)).otherwise(payload).alias("value"),
            (F.col("ms") + delay + F.col("_again")).alias("recv_ms"),
        )
    )


def connection_checks(probe: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return probe.select(
        "cluster_id",
        F.pmod("user_id", F.lit(12)).cast("int").alias("broker_id"),
        F.col("ms").alias("check_ms"),
        (~failed).alias("connected"),
        F.col("lat").alias("duration_ms"),
        F.when(failed, "ETIMEDOUT").alias("error"),
    )


def connection_roster(checks: DataFrame) -> DataFrame:
    """Brokers 0 to 12 of each cluster; no check ever tried broker 12."""
    return checks.select("cluster_id").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("broker_id"))


def log_lines(probe: DataFrame) -> DataFrame:
    kind, lat = F.col("event_type"), F.col("lat")
    head = F.lit("I0101 00:00:00.000000       1 ")
    where = F.concat(
        F.lit("partition="), F.col("partition"), F.lit(", offset="), F.col("event_id"), F.lit(", duration=")
    )
    received = F.when(lat < 1, F.lit(-3)).otherwise(2 * lat)
    broker = F.concat(F.lit("broker "), F.pmod("user_id", F.lit(12)), F.lit(" in "), lat, F.lit(" ms"))
    line = (
        F.when(lat == 7, F.concat(head, F.lit("consumer.go:10] Consumer refreshing metadata")))
        .when(
            kind.isin("click", "view"),
            F.concat(head, F.lit("producer.go:10] Message sent: "), where, lat, F.lit(" ms")),
        )
        .when(
            kind == "purchase",
            F.concat(
                head, F.lit("consumer.go:10] Message received: value={ProducerID:"), F.col("client_id"),
                F.lit(" MessageID:"), F.col("event_id"), F.lit(" Timestamp:"), F.col("ms"), F.lit("}, "),
                where, received, F.lit(" ms"),
            ),
        )
        .when(kind == "signup", F.concat(head, F.lit("connection_check.go:10] Connected to "), broker))
        .otherwise(
            F.concat(head, F.lit("connection_check.go:10] Error connecting to "), broker, F.lit(" (error [EOF])"))
        )
    )
    return probe.select("event_id", line.alias("value"))


def error_events(probe: DataFrame) -> DataFrame:
    steps = tuple(rule[0] for rule in C.ERROR_COUNTERS)
    return probe.where(F.col("event_type") == "error").select(
        "cluster_id",
        "client_id",
        F.concat(F.lit("topic-"), F.col("cluster_id")).alias("topic"),
        _choice(steps, F.col("user_id")).alias("step"),
        _choice(ERROR_CLASSES, F.col("event_id")).alias("error_class"),
        F.col("ms").alias("ts_ms"),
        F.when(F.pmod("event_id", F.lit(10)) < 8, F.pmod("event_id", F.lit(10)) != 0).alias("will_retry"),
    )


def fleet_clients(probe: DataFrame) -> DataFrame:
    """Known clients, and one per cluster that never reported anything."""
    return (
        probe.select("cluster_id", F.explode(F.array(F.col("client_id"), F.lit(SILENT_CLIENT))).alias("client_id"))
        .distinct()
        .select("*", F.concat(F.lit("topic-"), F.col("cluster_id")).alias("topic"))
    )


def rounds(probe: DataFrame) -> DataFrame:
    """Hourly probe rounds of each client over the partitions seen up to the hour's highest."""
    hour = F.col("ms") - F.pmod("ms", F.lit(HOUR_MS))
    return probe.groupBy("cluster_id", "client_id", hour.alias("tick")).agg(
        (F.max("partition") + 1).cast("bigint").alias("partitions")
    )


def planned_rounds(probe: DataFrame, plan: DataFrame) -> DataFrame:
    """Hourly probe rounds of each client over all planned partitions of its topic; client k probes topic k."""
    hour = F.col("ms") - F.pmod("ms", F.lit(HOUR_MS))
    topic = F.regexp_replace("client_id", "^client-", "topic-")
    ticks = probe.groupBy("cluster_id", "client_id", topic.alias("topic"), hour.alias("tick")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = plan.groupBy("cluster_id", "topic").agg(F.count(F.lit(1)).alias("partitions"))
    return ticks.join(sizes, ["cluster_id", "topic"]).select("cluster_id", "client_id", "tick", "partitions")


def metric_samples(probe: DataFrame) -> DataFrame:
    """Hourly scrapes of each client's counters, which restart every ten days.

    Each client is scraped at an own time within the hour, and not in hours without a probe; the last client is gone
    after LAST_SCRAPE_MS.
    """
    lat = F.col("lat")
    fine = F.col("event_type") != "error"
    back = fine & ~lat.between(40, 41)
    offset = F.pmod("user_id", F.lit(5)) * SCRAPE_OFFSET_MS
    hour = (F.col("ms") - F.pmod("ms", F.lit(HOUR_MS)) + HOUR_MS + offset).alias("scrape_ms")
    life = F.col("scrape_ms") - F.pmod("scrape_ms", F.lit(10 * DAY_MS))
    one = F.count(F.lit(1))
    alive = (F.col("client_id") != "client-4") | (F.col("ms") < LAST_SCRAPE_MS)
    hourly = probe.where(alive).groupBy("cluster_id", "client_id", "partition", hour).agg(
        one.alias("p_total"),
        F.count_if(fine).alias("p_n"),
        F.sum(F.when(fine, lat).otherwise(0)).alias("p_sum"),
        F.count_if(fine & (lat <= 400)).alias("p_400"),
        F.count_if(back).alias("c_n"),
        F.sum(F.when(back, 2 * lat).otherwise(0)).alias("c_sum"),
        F.count_if(back & (2 * lat <= 400)).alias("c_400"),
    )
    upto = W.partitionBy("cluster_id", "client_id", "partition", "_life").orderBy("scrape_ms").rowsBetween(W.unboundedPreceding, 0)
    columns = ("p_total", "p_n", "p_sum", "p_400", "c_n", "c_sum", "c_400")
    running = hourly.withColumn("_life", life).select(
        "cluster_id", "client_id", "partition", "scrape_ms", *[F.sum(c).over(upto).cast("double").alias(c) for c in columns]
    )
    base = [F.lit("cluster"), F.col("cluster_id"), F.lit("clientid"), F.col("client_id"), F.lit("partition"), F.col("partition").cast("string")]

    def sample(name, value, le=None):
        labels = F.create_map(*base, *([F.lit("le"), F.lit(le)] if le else []))
        return F.struct(F.lit(name).alias("name"), labels.alias("labels"), F.col(value).alias("value"))

    return running.select(
        "scrape_ms",
        F.inline(
            F.array(
                sample("records_produced_total", "p_total"),
                sample("records_produced_latency_sum", "p_sum"),
                sample("records_produced_latency_count", "p_n"),
                sample("records_produced_latency_bucket", "p_400", "400"),
                sample("records_produced_latency_bucket", "p_n", "+Inf"),
                sample("records_consumed_total", "c_n"),
                sample("records_consumed_latency_sum", "c_sum"),
                sample("records_consumed_latency_count", "c_n"),
                sample("records_consumed_latency_bucket", "c_400", "400"),
                sample("records_consumed_latency_bucket", "c_n", "+Inf"),
            )
        ),
    )


def config_snapshots(events: DataFrame) -> DataFrame:
    """Polls of one file per user; the file is away in error events and cut short in signups with k = 11."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    text = F.concat(F.lit('{"verbosityLogLevel": '), F.pmod(k, F.lit(3)), F.lit("}"))
    broken = (F.col("event_type") == "signup") & (k == 11)
    return events.select(
        _name("user-", F.col("user_id")).alias("path"),
        epoch_ms("ts").alias("poll_ms"),
        "event_id",
        (F.col("event_type") != "error").alias("exists"),
        F.when(F.col("event_type") != "error", F.when(broken, F.substring(text, 1, 20)).otherwise(text)).alias(
            "content"
        ),
    )


def observed_snapshots(probe: DataFrame) -> DataFrame:
    """Broker snapshots every four hours, of the brokers that views saw."""
    at = F.col("ms") - F.pmod("ms", F.lit(4 * HOUR_MS))
    return (
        probe.where(F.col("event_type") == "view")
        .select("cluster_id", at.alias("snapshot_ms"), F.pmod("user_id", F.lit(12)).cast("int").alias("broker_id"))
        .distinct()
    )


def hourly_checks(probe: DataFrame) -> DataFrame:
    """Checks at each half hour with a probe; cluster-1 expects a fixed size."""
    at = F.col("ms") - F.pmod("ms", F.lit(HOUR_MS)) + HOUR_MS // 2
    size = F.when(F.col("cluster_id") == "cluster-1", ROSTER_SIZE).otherwise(C.DYNAMIC_SIZE)
    failed = F.pmod(F.floor(at / HOUR_MS), F.lit(FAILED_EVERY)) == 0
    return probe.select(
        "cluster_id", at.alias("check_ms"), size.alias("expected_size"), failed.alias("describe_failed")
    ).distinct()


def join_events(orders: DataFrame) -> DataFrame:
    """A start and a ready signal per order."""
    client = F.pmod("o_custkey", F.lit(5))
    start = epoch_ms("o_orderdate")
    wait = F.pmod(F.floor("o_totalprice"), F.lit(60000))
    signals = F.array(
        F.struct(F.lit("start").alias("kind"), start.alias("ts_ms")),
        F.struct(F.lit("ready").alias("kind"), (start + wait).alias("ts_ms")),
    )
    return orders.select(
        _name("cluster-", F.pmod("o_custkey", F.lit(2))).alias("cluster_id"),
        _name("client-", client).alias("client_id"),
        F.col("o_orderkey").alias("attempt"),
        F.inline(signals),
    )


def broker_snapshots(supplier: DataFrame) -> DataFrame:
    """Clusters of ten brokers. Some brokers are missing in the second snapshot, a few have no rack."""
    first, second = 1704067200000, 1704153600000
    times = F.when(F.col("s_acctbal") >= 0, F.array(F.lit(first), F.lit(second))).otherwise(F.array(F.lit(first)))
    return supplier.select(
        _name("cluster-", F.floor(F.col("s_suppkey") / 10)).alias("cluster_id"),
        F.explode(times).alias("snapshot_ms"),
        F.col("s_suppkey").cast("int").alias("broker_id"),
        F.when(F.pmod("s_suppkey", F.lit(100)) == 9, "")
        .otherwise(_name("rack", F.pmod("s_nationkey", F.lit(3))))
        .alias("rack"),
    )


def topics(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.pmod(key, F.lit(7))
    error = F.when(kind == 0, C.UNKNOWN_TOPIC).when(kind == 1, "LEADER_NOT_AVAILABLE")
    config = F.coalesce(_choice(CONFIG_CHOICES["TOPIC_CONFIG"], key), F.lit(""))
    return part.select(
        _name("cluster-", F.floor(key / 200)).alias("cluster_id"),
        _name("topic-", F.pmod(key, F.lit(200))).alias("topic"),
        F.when(kind == 0, 0).otherwise(1 + F.pmod(size, F.lit(12))).alias("current_partitions"),
        F.when(F.pmod(size, F.lit(2)) == 0, C.DYNAMIC_SIZE).otherwise(EXPECTED_SIZE).alias("expected_size"),
        (F.pmod(key, F.lit(2)) == 0).alias("first_run"),
        error.alias("topic_error"),
        config.alias("topic_config"),
        (config != "").alias("has_config"),
    )


def topic_partitions(topic: DataFrame) -> DataFrame:
    """Snapshot rows of the existing partitions; the first replica leads and all are in sync."""
    return current_replicas(topic).select(
        "cluster_id",
        "topic",
        F.lit(None).cast("string").alias("topic_error"),
        "partition_id",
        F.col("replicas")[0].cast("int").alias("leader"),
        F.col("replicas").cast("array<int>").alias("replicas"),
        F.col("replicas").cast("array<int>").alias("isr"),
        F.array().cast("array<int>").alias("offline"),
    )


def current_replicas(topic: DataFrame) -> DataFrame:
    """Replicas of each existing partition, on two neighbours of ten brokers."""
    p = F.col("partition_id")
    partitions = topic.where(F.col("current_partitions") > 0).select(
        "cluster_id",
        "topic",
        F.explode(F.sequence(F.lit(0), F.col("current_partitions") - 1)).alias("partition_id"),
    )
    return partitions.withColumn("replicas", F.array(F.pmod(p, F.lit(10)), F.pmod(p + 1, F.lit(10))))


def _order_topic(key: str) -> tuple[Column, Column]:
    """Cluster and topic of an order; topic names repeat in all clusters."""
    number = F.col(key)
    return _name("cluster-", F.pmod(number, F.lit(3))).alias("cluster_id"), _name("topic-", F.floor(number / 3)).alias("topic")


def topic_leaders(lineitem: DataFrame, least_quantity: float = 0.0) -> DataFrame:
    """Leader of each partition of a topic, as lines of at least a quantity tell it."""
    return (
        lineitem.where(F.col("l_quantity") >= least_quantity)
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("_leader"))
        .select(
            *_order_topic("l_orderkey"),
            (F.col("l_linenumber") - 1).alias("partition_id"),
            F.pmod("_leader", F.lit(7)).alias("leader"),
        )
    )


def topic_sizes(orders: DataFrame) -> DataFrame:
    """Known for all topics but those of customers divisible by eleven."""
    return orders.where(F.pmod("o_custkey", F.lit(11)) != 0).select(
        *_order_topic("o_orderkey"), (F.pmod("o_custkey", F.lit(7)) + 1).alias("brokers")
    )


def reassignments(lineitem: DataFrame) -> DataFrame:
    empty = F.array().cast("array<int>")
    flag = F.col("_flag")
    return (
        lineitem.groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_returnflag").alias("_flag"), F.array(F.min("l_suppkey").cast("int")).alias("_broker"))
        .select(
            *_order_topic("l_orderkey"),
            (F.col("l_linenumber") - 1).alias("partition_id"),
            F.when(flag == "R", F.col("_broker")).otherwise(empty).alias("adding"),
            F.when(flag == "A", F.col("_broker")).otherwise(empty).alias("removing"),
        )
    )


def consumed_partitions(lineitem: DataFrame) -> DataFrame:
    """Partitions of the topics of parts; lines of even order keys speak of the next cluster."""
    key = F.col("l_partkey") + F.when(F.pmod("l_orderkey", F.lit(2)) == 0, 200).otherwise(0)
    return lineitem.select(
        _name("cluster-", F.floor(key / 200)).alias("cluster_id"), _name("topic-", F.pmod(key, F.lit(200))).alias("topic"), (F.col("l_linenumber") - 1).alias("partition_id")
    )


def configs(customer: DataFrame) -> DataFrame:
    """Configuration rows of one client per customer; keys that a client does not set have no row."""
    index = F.col("c_custkey")
    rows = [
        F.struct(F.lit(key).alias("key"), _choice(values, index).alias("value"))
        for key, values in CONFIG_CHOICES.items()
    ]
    rows.append(F.struct(F.lit("CLIENT_ID").alias("key"), F.col("c_name").alias("value")))
    return customer.select(_name("customer-", index).alias("client_id"), F.inline(F.array(*rows))).where(
        F.col("value").isNotNull()
    )


def backoff_targets(customer: DataFrame) -> DataFrame:
    return customer.select(
        _name("customer-", F.col("c_custkey")).alias("target"),
        *[_choice(values, F.col("c_custkey"), "bigint").alias(name) for name, values in BACKOFF_CHOICES.items()],
    )
