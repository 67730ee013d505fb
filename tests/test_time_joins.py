"""Reconciliation, rosters, join timeouts, rates, scrapes."""

import pytest
from pyspark.sql import functions as F

from probefleet.operators import latency, rates, reconcile, roster, scrape
from probefleet.sources import sinks, tables


def test_reconcile_and_lost(rows):
    produced = rows(
        "cluster_id STRING, client_id STRING, partition INT, message_id BIGINT, create_ms BIGINT",
        ("c", "x", 0, 1, 100), ("c", "x", 0, 2, 200), ("c", "x", 0, 1, 900), ("c", "x", 1, 3, 300), ("d", "x", 0, 1, 100),
    )
    text = '{{"producerId":"x","messageId":{},"timestamp":{}}}'
    records = rows(
        "cluster_id STRING, value STRING, recv_ms BIGINT",
        ("c", text.format(1, 100), 130), ("c", text.format(1, 100), 120), ("c", text.format(3, 300), 310), ("c", "bad", 1), ("d", "bad", 2),
    )
    decoded = latency.decode_records(records)
    got = {(r.cluster_id, r.message_id, r.create_ms): (r.received, r.copies, r.first_recv_ms) for r in reconcile.reconcile(produced, decoded).collect()}
    # The other cluster's client has the same name and sent the same message, which did not come back.
    assert got == {
        ("c", 1, 100): (True, 2, 120), ("c", 2, 200): (False, 0, None), ("c", 1, 900): (False, 0, None), ("c", 3, 300): (True, 1, 310),
        ("d", 1, 100): (False, 0, None),
    }
    lost = sorted((r.cluster_id, r.message_id, r.create_ms) for r in reconcile.lost(produced, decoded).collect())
    assert lost == [("c", 1, 900), ("c", 2, 200), ("d", 1, 100)]


def test_roster_asof(rows):
    snapshots = rows(
        "cluster_id STRING, snapshot_ms BIGINT, broker_id INT",
        *[(c, 10, 1) for c in "ds"], *[(c, 20, b) for c in "ds" for b in (1, 2, 3)], *[(c, 30, 1) for c in "ds"],
    )
    checks = rows(
        "cluster_id STRING, check_ms BIGINT, expected_size INT",
        *[("d", at, -1) for at in (5, 10, 25, 35)], *[("s", at, 3) for at in (5, 15, 25, 35, 9999)],
    )
    for width in (3, 1000000):
        found = {}
        for r in roster.roster_asof(checks, snapshots, width).collect():
            found.setdefault((r.cluster_id, r.check_ms), set()).add(r.broker_id)
        assert found == {
            ("d", 10): {1}, ("d", 25): {1, 2, 3}, ("d", 35): {1},
            ("s", 15): {1}, ("s", 25): {1, 2, 3}, ("s", 35): {1, 2, 3}, ("s", 9999): {1, 2, 3},
        }


def test_expected_size_never_seen_uses_the_newest(rows):
    snapshots = rows("cluster_id STRING, snapshot_ms BIGINT, broker_id INT", ("s", 10, 1), ("s", 20, 2))
    checks = rows("cluster_id STRING, check_ms BIGINT, expected_size INT", ("s", 15, 3), ("s", 25, 3))
    assert sorted(tuple(r)[1:] for r in roster.roster_asof(checks, snapshots).collect()) == [(15, 1), (25, 2)]


def test_failed_describe_and_changed_size(rows):
    snapshots = rows(
        "cluster_id STRING, snapshot_ms BIGINT, broker_id INT",
        ("s", 10, 1), *[("s", 20, b) for b in (1, 2)], *[("s", 30, b) for b in (1, 2, 3)], ("s", 40, 3),
    )
    checks = rows(
        "cluster_id STRING, check_ms BIGINT, expected_size INT, describe_failed BOOLEAN",
        ("s", 15, 2, True), ("s", 16, 2, None), ("s", 22, 2, True), ("s", 25, 2, False), ("s", 26, 2, True),
        ("s", 35, 3, False), ("s", 45, 3, True), ("s", 46, 2, False),
    )
    found = {}
    for r in roster.roster_asof(checks, snapshots).collect():
        found.setdefault(r.check_ms, set()).add(r.broker_id)
    assert found == {16: {1}, 25: {1, 2}, 26: {1, 2}, 35: {1, 2, 3}, 45: {1, 2, 3}, 46: {1, 2}}


def test_join_timeouts(rows):
    events = rows(
        "cluster_id STRING, client_id STRING, attempt BIGINT, kind STRING, ts_ms BIGINT",
        ("c", "x", 1, "start", 0), ("c", "x", 1, "ready", 30000), ("c", "x", 2, "start", 50000), ("c", "x", 2, "ready", 80001),
        ("c", "x", 3, "start", 99), ("c", "x", 4, "ready", 98), ("c", "x", 4, "start", 99),
        ("c", "y", 1, "start", 30719999), ("c", "y", 1, "ready", 30720001), ("c", "y", 1, "ready", 30720002),
    )
    got = {r.client_id: (r.attempts, r.timeouts) for r in roster.join_timeouts(events).collect()}
    assert got == {"x": (4, 3), "y": (1, 0)}


SAMPLES = "scrape_ms BIGINT, name STRING, labels MAP<STRING,STRING>, value DOUBLE"


def test_increase_handles_a_restart(rows):
    values = [(0, 1.0), (10, 4.0), (20, 9.0), (30, 2.0), (40, 3.0), (200, 8.0)]
    df = rows("series STRING, scrape_ms BIGINT, value DOUBLE", *[("s", at, v) for at, v in values])
    want = {10: (3.0, 10), 20: (8.0, 20), 30: (7.0, 20), 40: (3.0, 20), 50: (1.0, 10)}
    for chunk in (31, 64, 100000):
        got = rates.counter_increase(df, ["series"], 10, 30, chunk)
        assert {r.at_ms: (r.increase, r.covered_ms) for r in got.collect()} == want


def test_evaluation_times(rows):
    df = rows("at BIGINT", (0,), (1,), (10,), (-5,))
    got = {r.at: r.times for r in df.select("at", rates.evaluation_times(F.col("at"), 25, 10).alias("times")).collect()}
    assert got == {0: [0, 10, 20], 1: [10, 20], 10: [10, 20, 30], -5: [0, 10]}
    none = df.select(rates.evaluation_times(F.col("at") * 0 + 1, 5, 10).alias("times")).first()
    assert none.times == []


def test_targets_scraped_at_own_times(rows):
    # Two targets that count 60 a minute, 7 s apart, one with a gap, and one that has stopped long ago.
    data = []
    for target, offset in (("0", 0), ("1", 7000)):
        base = {"clientid": "c", "partition": "0", "cluster": target}
        for k in range(40):
            at = offset + 30000 * k
            if target == "1" and k in (20, 21):
                continue
            data += [(at, "records_consumed_total", base, 30.0 * k)]
            data += [(at, "records_consumed_latency_sum", base, 300.0 * k), (at, "records_consumed_latency_count", base, 30.0 * k)]
    data += [(0, "records_consumed_total", {"clientid": "gone"}, 5.0), (30000, "records_consumed_total", {"clientid": "gone"}, 500.0)]
    df = rows(SAMPLES, *data)
    counted = df.where("name = 'records_consumed_total'")
    per_minute = {r.at_ms: r.per_minute for r in rates.rate_per_minute(counted, 60000, 300000).collect()}
    assert all(per_minute[60000 * m] == 120.0 for m in range(6, 20))
    # The clusters' series of one client do not mix: 10 ms each.
    mean = {r.at_ms: r.mean_ms for r in rates.avg_latency(df, 60000, 300000).collect()}
    assert set(mean.values()) == {10.0}
    totals = {r.at_ms: r.total for r in rates.counter_total(counted, 60000, 300000).collect()}
    assert totals[0] == 5.0 and totals[300000] == 500.0 + 300.0 + 270.0 and totals[360000] == 360.0 + 330.0


def test_share_and_nothing_observed(rows):
    base = {"clientid": "c", "partition": "0"}
    data = []
    for at, n, total, fast in ((0, 10.0, 100.0, 8.0), (60000, 30.0, 500.0, 18.0), (120000, 30.0, 500.0, 18.0)):
        data += [
            (at, "records_consumed_latency_sum", base, total),
            (at, "records_consumed_latency_count", base, n),
            (at, "records_consumed_latency_bucket", {**base, "le": "400"}, fast),
            (at, "records_consumed_latency_bucket", {**base, "le": "+Inf"}, n),
        ]
    df = rows(SAMPLES, *data)
    mean = {(r.metric, r.at_ms): r.mean_ms for r in rates.avg_latency(df, 60000, 60001).collect()}
    assert mean == {("records_consumed_latency", 60000): 20.0, ("records_consumed_latency", 120000): None}
    share = {r.at_ms: r.percentage for r in rates.share_under(df, 60000, "400", 60001).collect()}
    assert share == {60000: 50.0, 120000: None}


def test_growth_between_scrapes(rows):
    df = rows(SAMPLES, (1, "a", {}, 1.0), (2, "a", {}, 2.0), (9, "a", {}, 2.0), (1, "b", {"x": "1"}, 5.0), (9, "b", {"x": "1"}, 4.0))
    for width in (1, 1000):
        got = {(r.series, r.scrape_ms): r.grew for r in rates.scrape_growth(df, width).collect()}
        assert got == {("a", 1): False, ("a", 2): True, ("a", 9): False, ('b{x="1"}', 1): False, ('b{x="1"}', 9): False}


@pytest.mark.parametrize(
    "line, want",
    [
        ('records_produced_total{clientid="c",partition="0"} 1', ("records_produced_total", {"clientid": "c", "partition": "0"}, 1.0)),
        ("client_creation_error_total 4", ("client_creation_error_total", {}, 4.0)),
        ('a_bucket{le="+Inf"} 2 1700000000000', ("a_bucket", {"le": "+Inf"}, 2.0)),
        ('a{x="say \\"hi\\" {b} \\\\n",y="l\\nm",} 1e+06', ("a", {"x": 'say "hi" {b} \\n', "y": "l\nm"}, 1e6)),
        ("a{} +Inf", ("a", {}, float("inf"))),
        ("a\t-2.5", None),
        ("  a   -2.5  ", ("a", {}, -2.5)),
        ("# TYPE a counter", None),
        ("HELP a counter of things", None),
        ("", None),
        ('a{x="1" 5', None),
        ('a{x=1} 5', None),
        ('a{x="1",x="2"} 5', None),
        ("a five", None),
        ("a 5 6 7", None),
        ("1a 5", None),
        ("a 1d", None),
        ("a 5.0f", None),
        ("a NaN", "nan"),
    ],
)
def test_exposition_line(rows, line, want):
    got = [(r.name, r.labels, r.value) for r in scrape.parse_exposition(rows("value STRING", (line,))).collect()]
    if want == "nan":
        assert len(got) == 1 and got[0][2] != got[0][2]
        return
    assert got == ([want] if want else [])


def test_exposition_file_round_trip(spark, rows, tmp_path):
    hist = rows(
        "b INT, le STRING, bucket_count BIGINT, sum BIGINT, count BIGINT",
        (0, "100", 1, 2000023, 2), (0, "+Inf", 2, 2000023, 2),
    )
    samples = scrape.histogram_samples(hist, "connection_latency", {"brokerid": "b"}).unionByName(
        scrape.counter_samples(rows("n BIGINT", (4,)), "client_creation_error_total", {}, "n")
    )
    sinks.write_exposition(samples, str(tmp_path / "out" / "scrape_ms=77"), "probe_")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "scrape_ms=77")).collect()]
    assert sorted(lines) == sorted([
        "# HELP probe_client_creation_error_total Errors while creating a client",
        "# TYPE probe_client_creation_error_total counter",
        "probe_client_creation_error_total 4",
        "# HELP probe_connection_latency Milliseconds of connection checks, successful or not",
        "# TYPE probe_connection_latency histogram",
        'probe_connection_latency_bucket{brokerid="0",le="100"} 1',
        'probe_connection_latency_bucket{brokerid="0",le="+Inf"} 2',
        'probe_connection_latency_sum{brokerid="0"} 2.000023e+06',
        'probe_connection_latency_count{brokerid="0"} 2',
    ])
    assert lines.index("# TYPE probe_connection_latency histogram") < lines.index('probe_connection_latency_sum{brokerid="0"} 2.000023e+06')
    back = scrape.parse_exposition(tables.read_scrapes(spark, str(tmp_path / "out")))
    assert back.count() == 5 and {r.scrape_ms for r in back.collect()} == {77}
    assert back.where(F.col("name").endswith("_sum")).first().value == 2000023.0
