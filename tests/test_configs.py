"""Configurations, their changes, retry schedules."""

import pytest
from pyspark.sql import functions as F

from probefleet.operators import configs, retry
from probefleet.sources import tables

CONFIG = "client_id STRING, key STRING, value STRING"
CUSTOM = {
    "KAFKA_BOOTSTRAP_SERVERS": "kafka-broker-1:9092,kafka-broker-2:9092",
    "KAFKA_BOOTSTRAP_BACKOFF_MAX_ATTEMPTS": "3",
    "TOPIC": "my-topic",
    "TOPIC_CONFIG": "retention.ms=600000;segment.bytes=16384;cleanup.policy=compact,delete",
    "CLIENT_ID": "my-client-id",
    "PRODUCER_LATENCY_BUCKETS": "400,800,1600,3200,6400",
    "EXPECTED_CLUSTER_SIZE": "3",
    "SARAMA_LOG_ENABLED": "true",
    "TLS_ENABLED": "true",
    "TLS_CA_CERT": "CA cert",
    "SASL_MECHANISM": "PLAIN",
    "SASL_USER": "user",
    "SASL_PASSWORD": "password",
    "STATUS_TIME_WINDOW_MS": "200000",
    "PROMETHEUS_CONSTANT_LABELS": "retry.backoff.ms=10000;request.timeout.ms=10000",
}


def test_typed_defaults_and_custom_values(rows):
    df = rows(CONFIG, ("plain", "SOMETHING", "x"), ("plain", "TOPIC", ""), *[("custom", k, v) for k, v in CUSTOM.items()])
    got = {r.client_id: r for r in configs.typed_config(df).collect()}
    plain, custom = got["plain"], got["custom"]
    assert plain.kafka_bootstrap_servers == ["localhost:9092"] and plain.topic == "" and plain.topic_config is None
    assert plain.expected_cluster_size == -1 and plain.tls_enabled is False and plain.own_client_id == "probe-client"
    assert plain.producer_latency_buckets == [2, 5, 10, 20, 50, 100, 200, 400]
    assert plain.endtoend_latency_buckets == [5, 10, 20, 50, 100, 200, 400, 800]
    assert plain.connection_check_latency_buckets == [100, 200, 400, 800, 1600]
    assert (plain.status_check_interval_ms, plain.status_time_window_ms) == (30000, 300000)
    assert custom.kafka_bootstrap_servers == ["kafka-broker-1:9092", "kafka-broker-2:9092"]
    assert custom.topic_config == {"retention.ms": "600000", "segment.bytes": "16384", "cleanup.policy": "compact,delete"}
    assert custom.prometheus_constant_labels == {"retry.backoff.ms": "10000", "request.timeout.ms": "10000"}
    assert (custom.kafka_bootstrap_backoff_max_attempts, custom.expected_cluster_size) == (3, 3)
    assert custom.producer_latency_buckets == [400, 800, 1600, 3200, 6400]
    assert custom.sarama_log_enabled is True and custom.own_client_id == "my-client-id"


def test_clients_that_set_nothing_known(rows):
    df = rows(CONFIG, ("other", "SOMETHING", "x"))
    clients = rows("client_id STRING", ("silent",), ("other",))
    typed = configs.typed_config(df, clients=clients).collect()
    assert sorted(r.client_id for r in typed) == ["other", "silent"] and {r.topic for r in typed} == {"__probe"}
    assert {r.client_id for r in configs.redact_config(df, clients).collect()} == {"other", "silent"}
    assert {r.client_id for r in configs.lint_config(df).collect()} == {"other"}


def test_rows_are_not_sorted_in_the_task_that_reads_them(rows):
    df = rows(CONFIG, *[(f"c{i % 7}", k, f"{v}{i}") for i in range(40) for k, v in CUSTOM.items()], ("n", None, "x"), (None, "TOPIC", "t"))
    wide = configs.wide_config(df, ["TOPIC", "SASL_USER"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    reading = plan[plan.rindex("Exchange hashpartitioning(") :]
    assert plan.count("Exchange hashpartitioning(") == 1 and "Sort" not in reading and "Aggregate" not in reading
    got = {r.client_id: (r.set_TOPIC, r.set_SASL_USER) for r in wide.collect()}
    greatest = {f"c{k}": tuple(max(f"{CUSTOM[x]}{i}" for i in range(k, 40, 7)) for x in ("TOPIC", "SASL_USER")) for k in range(7)}
    assert got == greatest | {"n": (None, None), None: ("t", None)}


def test_printed_values_are_the_understood_ones(rows):
    df = rows(CONFIG, ("c", "EXPECTED_CLUSTER_SIZE", "three"), ("c", "TLS_ENABLED", "T"), ("c", "VERBOSITY_LOG_LEVEL", "+7"), ("c", "SARAMA_LOG_ENABLED", "on"))
    got = {r.key: r.shown for r in configs.redact_config(df).collect()}
    assert (got["EXPECTED_CLUSTER_SIZE"], got["TLS_ENABLED"], got["VERBOSITY_LOG_LEVEL"]) == ("0", "true", "7")
    assert (got["SARAMA_LOG_ENABLED"], got["RECONCILE_INTERVAL_MS"], got["TOPIC"]) == ("false", "30000", "__probe")


def test_secrets_are_not_shown(rows):
    scram = {**CUSTOM, "SASL_MECHANISM": "SCRAM-SHA-256"}
    df = rows(CONFIG, *[("plain", k, v) for k, v in CUSTOM.items()], *[("scram", k, v) for k, v in scram.items()])
    got = {(r.client_id, r.key): r.shown for r in configs.redact_config(df).collect()}
    assert got["plain", "TLS_CA_CERT"] == "[CA cert]" and got["plain", "TLS_CLIENT_KEY"] == ""
    assert (got["plain", "SASL_USER"], got["plain", "SASL_PASSWORD"]) == ("[SASL user]", "[SASL password]")
    assert (got["scram", "SASL_USER"], got["scram", "SASL_PASSWORD"]) == ("", "")
    assert got["scram", "TOPIC"] == "my-topic" and ("scram", "EXPORTER_TYPE_TRACING") not in got


@pytest.mark.parametrize(
    "settings, broken",
    [
        ({"TOPIC": "t"}, set()),
        ({"SASL_MECHANISM": "PLAIN"}, {"sasl_user", "sasl_password"}),
        ({"SASL_MECHANISM": "PLAIN", "SASL_USER": "u", "SASL_PASSWORD": "p"}, set()),
        ({"SASL_MECHANISM": "SCRAM-SHA-512", "SASL_USER": "u"}, {"sasl_password"}),
        ({"SASL_MECHANISM": "GSSAPI"}, {"sasl_mechanism"}),
        ({"EXPORTER_TYPE_TRACING": "zipkin", "TOPIC_CONFIG": "=1"}, {"tracing_exporter", "topic_config"}),
        ({"PROMETHEUS_CONSTANT_LABELS": "a", "ENDTOEND_LATENCY_BUCKETS": "1, 2"}, {"constant_labels", "endtoend_buckets"}),
    ],
)
def test_lint(rows, settings, broken):
    df = rows(CONFIG, *[("c", k, v) for k, v in settings.items()])
    got = {r.rule: r.ok for r in configs.lint_config(df).collect()}
    assert len(got) == 9 and {rule for rule, ok in got.items() if not ok} == broken


def test_dynamic_config_text(rows):
    df = rows("l BOOLEAN, v INT", (True, 1), (None, 2), (None, None))
    got = [r.x for r in df.select(configs.dynamic_config_text(F.col("l"), F.col("v")).alias("x")).collect()]
    assert got == ["{SaramaLogEnabled:true, VerbosityLogLevel:1}", "{VerbosityLogLevel:2}", "{}"]


def test_topic_config_merge(rows):
    text = "cleanup.policy=compact;retention.ms=5"
    df = rows(
        "cluster_id STRING, topic STRING, topic_config STRING, brokers BIGINT, decision STRING",
        ("c", "new", text, 5, "CREATE"), ("d", "new", "", 1, "CREATE"), ("c", "old", text, 5, "REASSIGN"), ("c", "none", "", 5, "KEEP"),
    )
    found = {}
    for r in configs.merge_topic_config(df).collect():
        found.setdefault((r.cluster_id, r.topic), {})[r.key] = r.value
    assert found == {
        ("c", "new"): {"retention.ms": "5", "min.insync.replicas": "2", "cleanup.policy": "delete"},
        ("d", "new"): {"min.insync.replicas": "1", "cleanup.policy": "delete"},
        ("c", "old"): {"cleanup.policy": "compact", "retention.ms": "5"},
    }


def polls(*steps):
    return [("f", i * 10, content is not None, content) for i, content in enumerate(steps)]


A, B = '{"saramaLogEnabled": false, "verbosityLogLevel": 99}', '{"saramaLogEnabled": true, "verbosityLogLevel": 88}'


@pytest.mark.parametrize(
    "steps, want",
    [
        ([A, A], [(0, "apply")]),
        ([A, None, None], [(0, "apply"), (10, "default")]),
        ([A, B, B], [(0, "apply"), (10, "apply")]),
        ([A, None, A], [(0, "apply"), (10, "default")]),
        ([A, None, B, None], [(0, "apply"), (10, "default"), (20, "apply"), (30, "default")]),
        ([A, "{bad", A, B], [(0, "apply"), (30, "apply")]),
        ([A, '{"verbosityLogLevel": "high"}', B], [(0, "apply"), (20, "apply")]),
        ([None, A], [(10, "apply")]),
        (['{"other": 1}'], [(0, "apply")]),
    ],
)
def test_config_changes(rows, steps, want):
    df = rows("path STRING, poll_ms BIGINT, exists BOOLEAN, content STRING", *polls(*steps))
    for width in (10, 1000):
        got = configs.config_changes(df, width).orderBy("poll_ms").collect()
        assert [(r.poll_ms, r.event) for r in got] == want


def test_config_files(spark, rows, tmp_path):
    for at, content in ((10, A), (30, B)):
        folder = tmp_path / f"poll_ms={at}"
        folder.mkdir()
        (folder / "dynamic.json").write_text(content + "\n")
    found = tables.read_config_files(spark, str(tmp_path))
    expected = rows("path STRING, poll_ms BIGINT", *[("dynamic.json", at) for at in (10, 20, 30)])
    got = configs.config_changes(tables.with_absences(found, expected)).orderBy("poll_ms").collect()
    assert [(r.path, r.poll_ms, r.event) for r in got] == [
        ("dynamic.json", 10, "apply"), ("dynamic.json", 20, "default"), ("dynamic.json", 30, "apply")
    ]


def test_environment_files(spark, tmp_path):
    folder = tmp_path / "client_id=one"
    folder.mkdir()
    (folder / "env").write_text("# comment\nTOPIC_CONFIG=a=1;b=2\nTOPIC=\n=x\nrubbish\n")
    got = tables.read_environments(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in ("client_id", "key", "value")) for r in got) == [("one", "TOPIC", ""), ("one", "TOPIC_CONFIG", "a=1;b=2")]


@pytest.mark.parametrize(
    "target, want",
    [
        ((6, 0, 0), [200, 400, 800, 1600, 3200, 6400]),
        ((6, 360000, 300000), [300000] * 6),
        ((3, 200, 300000), [200, 400, 800]),
        ((3, 5000, 300000), [5000, 10000, 20000]),
        ((0, 5000, 300000), []),
        ((10, 5000, 300000), [5000, 10000, 20000, 40000, 80000, 160000, 300000, 300000, 300000, 300000]),
    ],
)
def test_retry_schedule(rows, target, want):
    df = rows("target STRING, max_attempts INT, scale_ms BIGINT, max_ms BIGINT", ("t", *target))
    got = retry.retry_schedule(df).orderBy("attempt").collect()
    assert [r.delay_ms for r in got] == want
    assert [r.elapsed_ms for r in got] == [sum(want[: i + 1]) for i in range(len(want))]
    assert all(r.last_outcome == "exceeded" for r in got)


def test_retry_delay_overflows(rows):
    df = rows("target STRING, max_attempts INT, scale_ms BIGINT, max_ms BIGINT", ("t", 100, 5000, 300000))
    got = retry.retry_schedule(df).collect()
    assert len(got) == next(a for a in range(100) if 5000 * 10**6 << a >= 2**63)
    assert {r.last_outcome for r in got} == {"overflow"}
