"""Ring, percentage, sampled counters, status document."""

import random

import pytest

from probefleet.operators import status


class Ring:
    """A small model: the last N values."""

    def __init__(self, size):
        self.size, self.values = size, []

    def put(self, value):
        self.values = [*self.values, value][-self.size :]


def test_ring_literal(rows):
    samples = rows("cluster_id STRING, client_id STRING, tick BIGINT, produced BIGINT, consumed BIGINT", *[("k", "c", i * 2000, i, i) for i in range(1, 7)])
    got = {r.tick // 2000: (r.produced_tail, r.produced_head, r["count"]) for r in status.status_ring(samples, 10000, 2000).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 2, 2), 3: (1, 3, 3), 4: (1, 4, 4), 5: (1, 5, 5), 6: (2, 6, 5)}


@pytest.mark.parametrize("size", [1, 2, 5, 10, 384, 1200, 5000])
def test_ring_equals_model(spark, size):
    rnd = random.Random(size)
    data, want = [], {}
    for cluster, client in (("k", "x"), ("l", "x"), ("k", "y")):
        ring, produced, consumed = Ring(size), 0, 0
        for tick in range(-3, 6000 if (cluster, client) == ("k", "x") else 9):
            produced, consumed = produced + rnd.choice([0, 0, 3]), consumed + rnd.randint(0, 4)
            ring.put((produced, consumed))
            data.append((cluster, client, tick * 1000, produced, consumed))
            (p0, c0), (p1, c1) = ring.values[0], ring.values[-1]
            share = -1.0 if p1 == p0 else int((c1 - c0) * 100 / (p1 - p0) * 100 + 0.5) / 100
            want[cluster, client, tick * 1000] = (len(ring.values), len(ring.values) * 1000, share)
    samples = spark.createDataFrame(data, "cluster_id STRING, client_id STRING, tick BIGINT, produced BIGINT, consumed BIGINT")
    got = status.status_window(samples, size * 1000, 1000).collect()
    assert {(r.cluster_id, r.client_id, r.tick): (r["count"], r.time_window, r.percentage) for r in got} == want


def test_ring_size():
    assert status.ring_size(300000, 30000) == 10
    assert status.ring_size(10 * 3600 * 1000, 30000) == 1200
    with pytest.raises(ValueError):
        status.ring_size(1000, 2000)


def test_counters_are_sampled_at_every_tick(rows):
    produced = rows(
        "cluster_id STRING, client_id STRING, ack_ms BIGINT",
        ("k", "x", 5), ("k", "x", 999), ("k", "x", 1000), ("k", "x", 5_000_500), ("l", "x", 7),
    )
    consumed = rows("cluster_id STRING, client_id STRING, recv_ms BIGINT", ("k", "x", 1001), ("k", "x", 5_000_999))
    got = {(r.cluster_id, r.tick): (r.produced, r.consumed) for r in status.sample_counters(produced, consumed, 1000).collect()}
    assert len([k for k in got if k[0] == "k"]) == 5001 and got["l", 1000] == (1, 0)
    assert got["k", 1000] == (2, 0) and got["k", 2000] == (3, 1) and got["k", 5_000_000] == (3, 1)
    assert got["k", 5_001_000] == (4, 2)


def test_status_document(rows):
    df = rows(
        "cluster_id STRING, client_id STRING, tick BIGINT, time_window BIGINT, percentage DOUBLE",
        ("k", "x", 1, 150000, 100.0), ("k", "x", 2, 30000, -1.0), ("k", "x", 3, 300000, 66.67),
    )
    assert [r.json for r in status.to_status_json(df).orderBy("tick").collect()] == [
        '{"Consuming":{"TimeWindow":150000,"Percentage":100}}',
        '{"Consuming":{"TimeWindow":30000,"Percentage":-1}}',
        '{"Consuming":{"TimeWindow":300000,"Percentage":66.67}}',
    ]


def test_newest_status(rows):
    df = rows("cluster_id STRING, client_id STRING, tick BIGINT, time_window BIGINT, percentage DOUBLE", ("k", "x", 1, 5, 1.0), ("k", "x", 3, 7, -1.0), ("l", "x", 2, 9, 50.0))
    assert sorted(tuple(r) for r in status.newest_status(df).collect()) == [("k", "x", 3, 7, -1.0), ("l", "x", 2, 9, 50.0)]


def test_implausible_times_are_counted(rows):
    df = rows("cluster_id STRING, client_id STRING, ms BIGINT", ("k", "x", 0), ("k", "x", 100), ("k", "x", 200), ("l", "x", None))
    assert [r.ms for r in status.plausible_times(df, "ms", 50, 200).collect()] == [100]
    got = {r.cluster_id: (r.too_early, r.too_late, r.no_time) for r in status.implausible_times(df, "ms", 50, 200).collect()}
    assert got == {"k": (1, 1, 0), "l": (0, 0, 1)}
