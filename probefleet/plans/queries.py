"""The registered queries: operators over the probe tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.functions.lookups import is_disconnection
from probefleet.functions.labels import with_labels
from probefleet.functions.keyvalue import pairs_map
from probefleet.functions.payload import decode_payload, encode_payload
from probefleet.operators import (
    configs,
    counters,
    histograms,
    latency,
    logs,
    rates,
    reconcile,
    retry,
    roster,
    scrape,
    status,
    topology,
)
from probefleet.plans import fixtures as fx
from probefleet.plans import streams
from probefleet.session import shared_folder
from probefleet.sources import outbox, tables

Query = Callable[[SparkSession, str], DataFrame]

TICK_MS = fx.HOUR_MS
STATUS_MS = 10 * fx.HOUR_MS
RATE_MS = 6 * fx.HOUR_MS
SERIES_KEYS = ("cluster_id", "client_id", "partition")
CONSTANT_LABELS = "site=one;partition=fixed"


class Tables:
    """The probe tables of one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @cached_property
    def probes(self) -> DataFrame:
        return fx.probes(self.raw("events"))

    @cached_property
    def attempts(self) -> DataFrame:
        return fx.produce_attempts(self.probes)

    @cached_property
    def records(self) -> DataFrame:
        return fx.consume_records(self.probes)

    @cached_property
    def decoded(self) -> DataFrame:
        return latency.decode_records(self.records)

    @cached_property
    def checks(self) -> DataFrame:
        return fx.connection_checks(self.probes)

    @cached_property
    def log_rows(self) -> DataFrame:
        return logs.parse_log_lines(fx.log_lines(self.probes))

    @cached_property
    def increments(self) -> DataFrame:
        """Records by tick, those of wrong clocks left out; status_implausible counts such."""
        sent = status.plausible_times(self.attempts, "ack_ms", fx.CLOCK_FROM_MS, fx.CLOCK_UNTIL_MS)
        back = status.plausible_times(self.records, "recv_ms", fx.CLOCK_FROM_MS, fx.CLOCK_UNTIL_MS)
        return status.tick_increments(sent, back, TICK_MS)

    @cached_property
    def samples(self) -> DataFrame:
        return status.accumulate(self.increments, TICK_MS)

    @cached_property
    def metrics(self) -> DataFrame:
        return fx.metric_samples(self.probes)

    @cached_property
    def brokers(self) -> DataFrame:
        return topology.latest_roster(fx.broker_snapshots(self.raw("supplier")))

    @cached_property
    def sizes(self) -> DataFrame:
        return topology.replication_params(self.brokers).select("cluster_id", "brokers")

    @cached_property
    def topics(self) -> DataFrame:
        return fx.topics(self.raw("part"))

    @cached_property
    def decided(self) -> DataFrame:
        return topology.decide(self.topics, self.sizes)

    @cached_property
    def configs(self) -> DataFrame:
        return fx.configs(self.raw("customer"))


def log_latency_rows(t: Tables) -> DataFrame:
    return t.log_rows


def log_files_mean(t: Tables) -> DataFrame:
    """Mean latencies of log lines that lie in text files."""
    path = shared_folder(t.spark, "logs")
    fx.log_lines(t.probes).select("value").write.text(path)
    return logs.latency_mean(logs.parse_log_lines(tables.read_log_lines(t.spark, path)))


def log_latency_mean(t: Tables) -> DataFrame:
    return logs.latency_mean(t.log_rows)


def log_quantiles_exclusive(t: Tables) -> DataFrame:
    return logs.latency_quantiles(t.log_rows, 4, "exclusive")


def log_quantiles_inclusive(t: Tables) -> DataFrame:
    return logs.latency_quantiles(t.log_rows, 10, "inclusive")


def records_produced(t: Tables) -> DataFrame:
    return counters.produced_totals(t.attempts)


def records_consumed(t: Tables) -> DataFrame:
    return counters.consumed_totals(t.records)


def produce_latency(t: Tables) -> DataFrame:
    return latency.with_produce_latency(t.attempts).select(
        "cluster_id", "client_id", "partition", "message_id", "latency_ms"
    )


def e2e_latency(t: Tables) -> DataFrame:
    return latency.with_e2e_latency(t.decoded).select(
        "cluster_id", "client_id", "partition", "offset", "recv_ms", "latency_ms", "is_malformed"
    )


def produce_latency_hist(t: Tables) -> DataFrame:
    rows = latency.with_produce_latency(t.attempts)
    return histograms.latency_histogram(rows, "latency_ms", SERIES_KEYS, C.PRODUCE_BOUNDS)


def e2e_latency_hist(t: Tables) -> DataFrame:
    rows = latency.with_e2e_latency(t.decoded)
    return histograms.latency_histogram(rows, "latency_ms", SERIES_KEYS, C.END_TO_END_BOUNDS)


def connection_latency_hist(t: Tables) -> DataFrame:
    keys = ("cluster_id", "broker_id", "connected")
    return histograms.latency_histogram(t.checks, "duration_ms", keys, C.CONNECTION_BOUNDS)


def connection_totals(t: Tables) -> DataFrame:
    return counters.connection_totals(t.checks, fx.connection_roster(t.checks))


def error_totals(t: Tables) -> DataFrame:
    """Counters by client and by cluster."""
    found = counters.error_counters(fx.error_events(t.probes), fx.fleet_clients(t.probes))
    return found.where(~F.col("metric").startswith("topic_")).drop("topic")


def topic_errors(t: Tables) -> DataFrame:
    """The topic's five counters."""
    found = counters.error_counters(fx.error_events(t.probes), fx.fleet_clients(t.probes))
    return found.where(F.col("metric").startswith("topic_")).drop("client_id")


def disconnections(t: Tables) -> DataFrame:
    errors = fx.error_events(t.probes)
    return errors.select(
        "cluster_id", "client_id", "ts_ms", "error_class", is_disconnection(F.col("error_class")).alias("disconnected")
    )


def payload_roundtrip(t: Tables) -> DataFrame:
    """Payloads as sent, then as cut after 20 characters where the latency is 20 ms."""
    text = encode_payload(F.col("client_id"), F.col("event_id"), F.col("ms"))
    arrived = F.when(F.col("lat") == 20, F.substring(text, 1, 20)).otherwise(text)
    rows = t.probes.select("event_id", arrived.alias("payload"))
    return rows.withColumn("_p", decode_payload(F.col("payload"))).select("event_id", "payload", "_p.*")


def status_implausible(t: Tables) -> DataFrame:
    """Received records whose time lies outside the month of the probes, by client."""
    return status.implausible_times(t.records, "recv_ms", fx.FIRST_MS, fx.LAST_SCRAPE_MS)


def status_samples(t: Tables) -> DataFrame:
    return t.samples


def status_ring(t: Tables) -> DataFrame:
    return status.status_ring(t.samples, STATUS_MS, TICK_MS)


def status_percentage(t: Tables) -> DataFrame:
    return status.status_window(t.samples, STATUS_MS, TICK_MS)


def status_json(t: Tables) -> DataFrame:
    return status.to_status_json(status.status_window(t.samples, STATUS_MS, TICK_MS))


def status_current(t: Tables) -> DataFrame:
    """What each client's status endpoint would answer now."""
    ring = status.current_ring(t.increments, STATUS_MS, TICK_MS)
    return status.to_status_json(status.status_of_ring(ring, TICK_MS))


def status_runs(t: Tables) -> DataFrame:
    """The ring of the last samples as runs of ticks between which nothing changes."""
    return status.ring_runs(t.increments, STATUS_MS, TICK_MS).drop("first")


def broker_order(t: Tables) -> DataFrame:
    return topology.broker_order(t.brokers)


def broker_files_racks(t: Tables) -> DataFrame:
    """Rack completeness of landed broker snapshots."""
    path = shared_folder(t.spark, "brokers")
    fx.broker_snapshots(t.raw("supplier")).write.parquet(path)
    return topology.rack_completeness(topology.latest_roster(tables.read_broker_snapshots(t.spark, path)))


def topic_files_replicas(t: Tables) -> DataFrame:
    """Replicas of landed topic snapshots in long form, in the order of topics and partitions."""
    path = shared_folder(t.spark, "topics")
    fx.topic_partitions(t.topics).write.parquet(path)
    return topology.in_partition_order(tables.replica_rows(tables.read_topic_snapshots(t.spark, path)))


def rack_completeness(t: Tables) -> DataFrame:
    return topology.rack_completeness(t.brokers)


def replication_params(t: Tables) -> DataFrame:
    return topology.replication_params(t.brokers)


def replica_plan(t: Tables) -> DataFrame:
    return topology.plan_replicas(t.topics, t.brokers)


def plan_quality(t: Tables) -> DataFrame:
    return topology.plan_quality(topology.planned_partitions(t.topics, t.brokers))


def reconcile_decision(t: Tables) -> DataFrame:
    return t.decided.select("cluster_id", "topic", "brokers", "dynamic", "decision", "alter_config", "refresh")


def topology_actions(t: Tables) -> DataFrame:
    return topology.topology_actions(t.decided, t.brokers, fx.current_replicas(t.topics))


def orphan_partitions(t: Tables) -> DataFrame:
    return topology.orphan_partitions(t.topics, t.sizes)


def topic_config_merge(t: Tables) -> DataFrame:
    return topology_configs(t).select("cluster_id", "topic", "key", "value")


def topology_configs(t: Tables) -> DataFrame:
    written = t.decided.where((F.col("decision") == "CREATE") | F.col("alter_config"))
    return configs.merge_topic_config(written)


def leader_mismatch(t: Tables) -> DataFrame:
    lines = t.raw("lineitem")
    return topology.leader_mismatch(fx.topic_leaders(lines), fx.topic_leaders(lines, 5.0))


def leader_election_needed(t: Tables) -> DataFrame:
    return topology.leader_election_needed(fx.topic_leaders(t.raw("lineitem")), fx.topic_sizes(t.raw("orders")))


def reassignment_ongoing(t: Tables) -> DataFrame:
    return topology.reassignment_ongoing(fx.reassignments(t.raw("lineitem")))


def partition_coverage(t: Tables) -> DataFrame:
    expected = fx.current_replicas(t.topics).select("cluster_id", "topic", "partition_id")
    return topology.partition_coverage(expected, fx.consumed_partitions(t.raw("lineitem")))


def partitions_unconsumed(t: Tables) -> DataFrame:
    expected = fx.current_replicas(t.topics).select("cluster_id", "topic", "partition_id")
    return topology.unconsumed_partitions(expected, fx.consumed_partitions(t.raw("lineitem")))


def probe_round(t: Tables) -> DataFrame:
    return topology.generate_round(fx.rounds(t.probes))


def probe_round_planned(t: Tables) -> DataFrame:
    """Probe rounds over every partition of the plan."""
    plan = topology.planned_partitions(t.topics, t.brokers)
    return topology.generate_round(fx.planned_rounds(t.probes, plan))


def actions_outbox(t: Tables) -> DataFrame:
    """What three runs publish: topics go and come between the first two, the third is as the second."""
    folder = shared_folder(t.spark, "outbox")
    # Each run looks at the actions several times, so they are worked out once.
    planned = topology_actions(t)
    planned.write.parquet(f"{folder}/actions")
    actions = t.spark.read.schema(planned.schema).parquet(f"{folder}/actions")
    number = F.pmod(F.regexp_extract("topic", r"(\d+)$", 1).cast("bigint"), F.lit(3))
    out = None
    for run, absent in enumerate((0, 1, 1)):
        rows = outbox.publish_actions(actions.where(number != absent), folder, run).withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out


def probe_reconcile(t: Tables) -> DataFrame:
    return reconcile.reconcile(t.attempts, t.decoded).select(
        "cluster_id", "client_id", "partition", "message_id", "received", "copies", "first_recv_ms"
    )


def probe_lost(t: Tables) -> DataFrame:
    return reconcile.lost(t.attempts, t.decoded).select(
        "cluster_id", "client_id", "partition", "message_id", "create_ms", "error"
    )


def join_timeouts(t: Tables) -> DataFrame:
    return roster.join_timeouts(fx.join_events(t.raw("orders")))


def roster_asof(t: Tables) -> DataFrame:
    return roster.roster_asof(fx.hourly_checks(t.probes), fx.observed_snapshots(t.probes))


def scrape_parse(t: Tables) -> DataFrame:
    """Metric samples written as text and read back, type comments included."""
    # The samples are looked at twice, so they are worked out once.
    path = shared_folder(t.spark, "samples")
    t.metrics.select("name", "labels", "value").write.parquet(path)
    samples = t.spark.read.schema(t.metrics.select("name", "labels", "value").schema).parquet(path)
    text = scrape.to_exposition(samples).select(F.col("line").alias("value"))
    comments = scrape.type_lines(samples).select(F.col("line").alias("value"))
    label = F.col("labels")
    return scrape.parse_exposition(text.unionByName(comments)).select(
        "name",
        label["cluster"].alias("cluster"),
        label["clientid"].alias("clientid"),
        label["partition"].alias("partition"),
        label["le"].alias("le"),
        "value",
    )


def exposition_lines(t: Tables) -> DataFrame:
    """The connection histogram as text."""
    labels = {"brokerid": "broker_id", "cluster": "cluster_id", "connected": "connected"}
    samples = scrape.histogram_samples(connection_latency_hist(t), "connection_latency", labels)
    return scrape.to_exposition(samples, "probe_").select("line")


def series_with_labels(t: Tables) -> DataFrame:
    """Produce counters with constant labels; a label of the series itself wins."""
    samples = scrape.counter_samples(
        counters.produced_totals(t.attempts),
        "records_produced_total",
        {"clientid": "client_id", "cluster": "cluster_id", "partition": "partition"},
        "produced_total",
    )
    labelled = samples.withColumn("labels", with_labels(F.col("labels"), pairs_map(F.lit(CONSTANT_LABELS))))
    return scrape.to_exposition(labelled).select("line")


def scrape_growth(t: Tables) -> DataFrame:
    return rates.scrape_growth(t.metrics)


def dashboard_totals(t: Tables) -> DataFrame:
    return rates.counter_total(t.metrics.where(F.col("name").endswith("_total")), fx.DAY_MS, RATE_MS)


def dashboard_rates(t: Tables) -> DataFrame:
    return rates.rate_per_minute(t.metrics.where(F.col("name").endswith("_total")), TICK_MS, RATE_MS)


def dashboard_avg_latency(t: Tables) -> DataFrame:
    return rates.avg_latency(t.metrics, TICK_MS, RATE_MS)


def dashboard_perf_index(t: Tables) -> DataFrame:
    return rates.share_under(t.metrics, TICK_MS, str(C.LATENCY_TARGET_MS), RATE_MS)


def config_typed(t: Tables) -> DataFrame:
    typed = configs.typed_config(t.configs)
    return typed.select(
        "client_id",
        "own_client_id",
        F.array_join("kafka_bootstrap_servers", "|").alias("kafka_bootstrap_servers"),
        "topic",
        "reconcile_interval_ms",
        "expected_cluster_size",
        "verbosity_log_level",
        "tls_enabled",
        "sasl_mechanism",
        F.size("producer_latency_buckets").alias("producer_buckets"),
        F.col("topic_config")["retention.ms"].alias("retention_ms"),
    )


def config_all(t: Tables) -> DataFrame:
    """Every key: lists as text, bounds by number and sum, maps by number of pairs, all others as they are."""
    typed = configs.typed_config(t.configs)

    def shown(key: str, kind: str) -> list[Column]:
        name = "own_client_id" if key == "CLIENT_ID" else key.lower()
        if kind == "list":
            return [F.array_join(name, "|").alias(name)]
        if kind == "buckets":
            total = F.aggregate(F.coalesce(name, F.array().cast("array<double>")), F.lit(0.0), lambda a, b: a + b)
            return [F.greatest(F.size(name), F.lit(0)).alias(f"{name}_n"), total.alias(f"{name}_sum")]
        if kind == "map":
            return [F.greatest(F.size(name), F.lit(0)).alias(f"{name}_n")]
        return [F.col(name)]

    return typed.select("client_id", *[c for key, kind, _ in C.CONFIG_KEYS for c in shown(key, kind)])


def config_kv(t: Tables) -> DataFrame:
    chosen = F.col("key").isin("TOPIC_CONFIG", "PROMETHEUS_CONSTANT_LABELS")
    return configs.pair_rows(t.configs.where(chosen))


def config_buckets(t: Tables) -> DataFrame:
    return configs.bound_rows(t.configs.where(F.col("key").endswith("_LATENCY_BUCKETS")))


def config_redacted(t: Tables) -> DataFrame:
    return configs.redact_config(t.configs)


def config_dynamic_text(t: Tables) -> DataFrame:
    """What a probe prints of each readable configuration file."""
    polls = fx.config_snapshots(t.raw("events"))
    return configs.dynamic_texts(polls).select("path", "poll_ms", "event_id", "shown")


def config_lint(t: Tables) -> DataFrame:
    return configs.lint_config(t.configs)


def config_changes(t: Tables) -> DataFrame:
    return configs.config_changes(fx.config_snapshots(t.raw("events")), ties=["event_id"])


def retry_schedule(t: Tables) -> DataFrame:
    return retry.retry_schedule(fx.backoff_targets(t.raw("customer")))


def probe_overview(t: Tables) -> DataFrame:
    """Flagship: per client the end-to-end latency histogram beside its newest status."""
    rows = latency.with_e2e_latency(t.decoded)
    client = ["cluster_id", "client_id"]
    hist = histograms.latency_histogram(rows, "latency_ms", client, C.END_TO_END_BOUNDS)
    newest = status.newest_status(status.status_window(t.samples, STATUS_MS, TICK_MS))
    return hist.join(newest.select(*client, "tick", "percentage"), client)


BATCH = (
    log_latency_rows,
    log_latency_mean,
    log_files_mean,
    log_quantiles_exclusive,
    log_quantiles_inclusive,
    records_produced,
    records_consumed,
    produce_latency,
    e2e_latency,
    produce_latency_hist,
    e2e_latency_hist,
    connection_latency_hist,
    connection_totals,
    error_totals,
    topic_errors,
    disconnections,
    payload_roundtrip,
    status_implausible,
    status_samples,
    status_ring,
    status_percentage,
    status_json,
    status_current,
    status_runs,
    broker_order,
    rack_completeness,
    broker_files_racks,
    topic_files_replicas,
    replication_params,
    replica_plan,
    plan_quality,
    reconcile_decision,
    topology_actions,
    actions_outbox,
    orphan_partitions,
    topic_config_merge,
    leader_mismatch,
    leader_election_needed,
    reassignment_ongoing,
    partition_coverage,
    partitions_unconsumed,
    probe_round,
    probe_round_planned,
    probe_reconcile,
    probe_lost,
    join_timeouts,
    roster_asof,
    scrape_parse,
    exposition_lines,
    series_with_labels,
    scrape_growth,
    dashboard_totals,
    dashboard_rates,
    dashboard_avg_latency,
    dashboard_perf_index,
    config_typed,
    config_all,
    config_kv,
    config_buckets,
    config_redacted,
    config_dynamic_text,
    config_lint,
    config_changes,
    retry_schedule,
    probe_overview,
)


def portable(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, whatever their width."""
    small = {"int", "smallint", "tinyint"}
    return df.select(
        *[F.col(f"`{name}`").cast("bigint").alias(name) if kind in small else F.col(f"`{name}`") for name, kind in df.dtypes]
    )


def registry() -> dict[str, Query]:
    def over_tables(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(Tables(spark, sf_dir)))

        query.__name__ = build.__name__
        return query

    named = {build.__name__: over_tables(build) for build in BATCH}
    return named | {build.__name__: over_tables(build) for build in streams.STREAMS}
