"""Counters, histograms, log mining."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.operators import counters, histograms, latency, logs
from probefleet.sources.tables import read_log_lines

LINES = {
    "I0101 10:00:00.000000       1 producer.go:10] Message sent: partition=0, offset=17, duration=151 ms": ("producer", 151),
    "I0101 10:00:00.000000       1 consumer.go:10] Message received: value={a}, partition=0, offset=1, duration=161 ms": ("e2e", 161),
    "I0101 10:00:00.000000       1 connection_check.go:10] Connected to broker 1 in 23 ms": ("connection", 23),
    "E0101 10:00:00.000000       1 connection_check.go:10] Error connecting to broker 2 in 8 ms (error [EOF])": ("connection", 8),
    "I0101 10:00:00.000000       1 connection_check.go:10] Connected to broker 12 in 5 ms": None,
    "I0101 10:00:00.000000       1 consumer.go:10] Message received: value={a}, partition=0, offset=1, duration=-3 ms": None,
    "I0101 10:00:00.000000       1 producer.go:10] Producer refreshing metadata": None,
    "": None,
}


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES))
    got = logs.parse_log_lines(read_log_lines(spark, [str(tmp_path / "a.log")]), strict=True)
    assert sorted((r.kind, r.duration_ms) for r in got.collect()) == sorted(x for x in LINES.values() if x)
    assert got.columns == ["path", "kind", "duration_ms"]


def test_log_lines_with_long_broker_ids(rows):
    df = rows("value STRING", *[(line,) for line in LINES])
    found = logs.parse_log_lines(df)
    assert sorted(r.duration_ms for r in found.where("kind = 'connection'").collect()) == [5, 8, 23]


def test_first_pattern_wins(rows):
    line = "producer.go:1] Message sent consumer.go:1] Message received duration=4 ms duration=9 ms"
    assert logs.parse_log_lines(rows("value STRING", (line,))).first()[:] == ("producer", 9)


@pytest.mark.parametrize("n", [2, 4, 7, 10, 100])
@pytest.mark.parametrize("method", ["exclusive", "inclusive"])
def test_quantiles_equal_the_library(spark, n, method):
    rnd = random.Random(n)
    groups = {f"g{size}": [rnd.randint(-20, 6000) for _ in range(size)] for size in (2, 3, 5, 17, 400)}
    groups["same"] = [8] * 50
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "kind STRING, duration_ms BIGINT")
    got = {(r.kind, r.i): r.q for r in logs.latency_quantiles(df, n, method, width=64).collect()}
    want = {
        (k, i): q for k, vs in groups.items() for i, q in enumerate(statistics.quantiles(vs, n=n, method=method), 1)
    }
    assert got == want


def test_quantiles_of_one_value_and_of_one_cut(rows):
    df = rows("kind STRING, duration_ms BIGINT", ("a", 5), ("b", None))
    assert [tuple(r) for r in logs.latency_quantiles(df, 3).orderBy("i").collect()] == [("a", 1, None), ("a", 2, None)]
    assert logs.latency_quantiles(df, 1).count() == 0
    with pytest.raises(ValueError):
        logs.latency_quantiles(df, 4, "nearest")


def test_mean(rows):
    df = rows("kind STRING, duration_ms BIGINT", ("a", 1), ("a", 2), ("a", 4), ("b", None))
    got = {r.kind: (r.mean_ms, r.n) for r in logs.latency_mean(df.where("duration_ms IS NOT NULL")).collect()}
    assert got == {"a": (7 / 3, 3)}


def test_histogram_is_cumulative_with_inclusive_bounds(rows):
    df = rows("k STRING, v BIGINT", ("a", 2), ("a", 5), ("a", -1), ("a", 900), ("a", None), ("b", None))
    got = histograms.latency_histogram(df, "v", ["k"], [2, 5, 400]).collect()
    assert [(r.k, r.le, r.bucket_count, r["sum"], r["count"]) for r in got] == [
        ("a", "2", 2, 906, 4), ("a", "5", 3, 906, 4), ("a", "400", 3, 906, 4), ("a", "+Inf", 4, 906, 4)
    ]


def test_histogram_bounds_must_ascend(rows):
    for bounds in ([], [5, 5], [5, 2]):
        with pytest.raises(ValueError):
            histograms.latency_histogram(rows("v BIGINT", (1,)), "v", [], bounds)


def test_failed_sends_count_but_have_no_latency(rows):
    attempts = rows(
        "cluster_id STRING, client_id STRING, partition INT, create_ms BIGINT, ack_ms BIGINT, error STRING",
        ("c", "x", 0, 100, 110, None), ("c", "x", 0, 200, 900, "timeout"), ("c", "x", 1, 300, 302, None),
    )
    got = {r.partition: (r.produced_total, r.produced_failed_total) for r in counters.produced_totals(attempts).collect()}
    assert got == {0: (2, 1), 1: (1, 0)}
    assert [r.latency_ms for r in latency.with_produce_latency(attempts).orderBy("create_ms").collect()] == [10, None, 2]


def test_malformed_record_counts_with_a_huge_latency(rows):
    records = rows(
        "cluster_id STRING, client_id STRING, partition INT, value STRING, recv_ms BIGINT",
        ("c", "x", 0, "bad", 1700000000000), ("c", "x", 0, '{"producerId":"x","messageId":1,"timestamp":1700000000005}', 1700000000000),
    )
    seen = latency.with_e2e_latency(latency.decode_records(records))
    assert sorted(r.latency_ms for r in seen.collect()) == [-5, 1700000000000]
    hist = histograms.latency_histogram(seen, "latency_ms", ["client_id"], C.END_TO_END_BOUNDS)
    assert {r.le: r.bucket_count for r in hist.collect()}["800"] == 1


def test_connection_totals_start_at_zero(rows):
    checks = rows("cluster_id STRING, broker_id INT, connected BOOLEAN", ("c", 0, True), ("c", 0, True), ("c", 0, False))
    roster = rows("cluster_id STRING, broker_id INT", ("c", 0), ("c", 1))
    got = {(r.broker_id, r.connected): (r.connection_total, r.connection_error_total) for r in counters.connection_totals(checks, roster).collect()}
    assert got == {(0, True): (2, 0), (0, False): (1, 1), (1, True): (0, 0), (1, False): (0, 0)}


def test_count_series(rows):
    df = rows("k STRING, bad BOOLEAN", ("a", True), ("a", False), ("b", False))
    universe = rows("k STRING", ("c",), ("a",))
    assert {r.k: r.value for r in counters.count_series(df, ["k"], universe).collect()} == {"a": 2, "b": 1, "c": 0}
    assert {r.k: r.value for r in counters.count_series(df, ["k"], where=F.col("bad")).collect()} == {"a": 1, "b": 0}


def test_error_counters(rows):
    errors = rows(
        "cluster_id STRING, client_id STRING, topic STRING, step STRING, will_retry BOOLEAN",
        ("c", "x", "t", "consume", False),
        ("c", "x", "t", "client_creation", True),
        ("c", "x", "t", "client_creation", False),
        ("c", "x", "t", "expected_size", False),
        ("c", "x", "t", "describe_topic", False),
        ("c", "x", "t", "something else", True),
        ("c", "y", "t", "producer_refresh", None),
        ("c", "y", "t", "client_creation", None),
    )
    clients = rows("cluster_id STRING, client_id STRING, topic STRING", ("c", "x", "t"), ("c", "y", "t"))
    got = {(r.metric, r.client_id, r.topic): r.value for r in counters.error_counters(errors, clients).collect()}
    assert got == {
        ("consumer_error_total", "x", ""): 1,
        ("consumer_error_total", "y", ""): 0,
        ("producer_refresh_metadata_error_total", "x", ""): 0,
        ("producer_refresh_metadata_error_total", "y", ""): 1,
        ("consumer_refresh_metadata_error_total", "x", ""): 0,
        ("consumer_refresh_metadata_error_total", "y", ""): 0,
        ("client_creation_error_total", "", ""): 1,
        ("expected_cluster_size_error_total", "", ""): 0,
        ("topic_creation_failed_total", "", "t"): 0,
        ("topic_describe_cluster_error_total", "", ""): 0,
        ("topic_describe_error_total", "", "t"): 1,
        ("topic_alter_assignments_error_total", "", "t"): 0,
        ("topic_alter_configuration_error_total", "", "t"): 0,
    }
