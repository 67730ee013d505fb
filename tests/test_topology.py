"""Broker order, plans, decisions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probefleet.operators import topology

BROKERS = "cluster_id STRING, broker_id INT, rack STRING"
TOPICS = "cluster_id STRING, topic STRING, current_partitions INT"


def model_order(brokers):
    """Ids by rack in turn; ``brokers`` maps id to rack."""
    ids = sorted(brokers)
    if not all(brokers.values()):
        return ids
    by_rack = {}
    for i in ids:
        by_rack.setdefault(brokers[i], []).append(i)
    turns = max(map(len, by_rack.values()))
    return [rack[k] for k in range(turns) for rack in by_rack.values() if k < len(rack)]


def order_of(df):
    found = {}
    for r in topology.broker_order(df).collect():
        found.setdefault(r.cluster_id, {})[r.position] = r.broker_id
    return {c: [ids[i] for i in range(len(ids))] for c, ids in found.items()}


def test_literal_order(rows):
    racks = {0: "rack1", 1: "rack3", 2: "rack3", 3: "rack2", 4: "rack2", 5: "rack1"}
    assert order_of(rows(BROKERS, *[("c", i, r) for i, r in racks.items()])) == {"c": [0, 1, 3, 5, 2, 4]}


def test_order_equals_model(spark):
    rnd = random.Random(11)
    clusters = {}
    for c in range(12):
        ids = rnd.sample(range(300000), rnd.choice([1, 2, 7, 60]))
        racks = rnd.choice([1, 2, 3, 50])
        clusters[f"c{c}"] = {i: f"r{rnd.randrange(racks)}" for i in ids}
    clusters["mixed"] = {5: "a", 3: "", 9: "b"}
    clusters["none"] = {5: "", 3: "", 9: ""}
    df = spark.createDataFrame([(c, i, r) for c, b in clusters.items() for i, r in b.items()], BROKERS)
    assert order_of(df) == {c: model_order(b) for c, b in clusters.items()}


@pytest.mark.parametrize(
    "partitions, brokers, racks, min_isr, busy",
    [(1, 1, 0, 1, set()), (3, 3, 0, 2, set()), (3, 2, 0, 1, {0}), (6, 6, 3, 2, set())],
)
def test_plans(rows, partitions, brokers, racks, min_isr, busy):
    ids = list(range(brokers))
    random.Random(3).shuffle(ids)
    df = rows(BROKERS, *[("c", i, f"rack{n % racks}" if racks else "") for n, i in enumerate(ids)])
    topics = rows(TOPICS, ("c", "t", partitions))
    plan = topology.plan_replicas(topics, df)
    planned = topology.planned_partitions(topics, df)
    found = {}
    for r in plan.collect():
        found.setdefault(r.partition_id, {})[r.replica_idx] = r.broker_id
    assert len(found) == max(partitions, brokers)
    order = model_order({r.broker_id: r.rack for r in df.collect()})
    for p, replicas in found.items():
        assert [replicas[i] for i in range(len(replicas))] == [order[(p + i) % brokers] for i in range(min(brokers, 3))]
    leads = Counter(r[0] for r in found.values())
    assert {b for b, n in leads.items() if n > 1} == busy
    params = topology.replication_params(df).first()
    assert (params.brokers, params.rf, params.min_isr) == (brokers, min(brokers, 3), min_isr)
    quality = topology.plan_quality(planned).first()
    assert (quality.dup_broker, quality.dup_rack, quality.max_leaders) == (False, False, 2 if busy else 1)


def test_bad_plans_are_seen(rows):
    planned = rows(
        "cluster_id STRING, topic STRING, replicas ARRAY<INT>, racks ARRAY<STRING>",
        ("c", "same broker", [1, 1], ["a", "a"]), ("c", "same rack", [1, 2], ["a", "a"]), ("d", "same rack", [1, 2], ["a", "b"]),
        ("c", "one leader", [1], ["a"]), ("c", "one leader", [1], ["a"]), ("c", "no rack", [3, 4], ["", ""]),
    )
    got = {(r.cluster_id, r.topic): (r.dup_broker, r.dup_rack, r.max_leaders) for r in topology.plan_quality(planned).collect()}
    assert got == {
        ("c", "same broker"): (True, True, 1), ("c", "same rack"): (False, True, 1), ("d", "same rack"): (False, False, 1),
        ("c", "one leader"): (False, False, 2), ("c", "no rack"): (False, False, 1),
    }


def test_latest_roster(rows):
    df = rows(
        "cluster_id STRING, snapshot_ms BIGINT, broker_id INT, rack STRING",
        ("c", 1, 1, "a"), ("c", 1, 2, "b"), ("c", 2, 1, None), ("c", 2, 1, None), ("d", 1, 7, "x"),
    )
    assert sorted(tuple(r) for r in topology.latest_roster(df).collect()) == [("c", 1, ""), ("d", 7, "x")]


DECIDE = "cluster_id STRING, topic STRING, current_partitions INT, expected_size INT, first_run BOOLEAN, topic_error STRING, has_config BOOLEAN"


def test_decisions(rows):
    unknown, other = "UNKNOWN_TOPIC_OR_PARTITION", "LEADER_NOT_AVAILABLE"
    topics = rows(
        DECIDE,
        ("c", "new dynamic", 0, -1, True, unknown, True),
        ("c", "new complete", 0, 3, False, unknown, False),
        ("c", "new waiting", 0, 4, True, unknown, False),
        ("c", "dynamic", 2, -1, False, None, True),
        ("c", "even", 3, -1, False, None, False),
        ("c", "first complete", 3, 3, True, None, True),
        ("c", "first incomplete", 3, 4, True, None, True),
        ("c", "later complete", 5, 3, False, None, True),
        ("c", "broken", 3, -1, True, other, True),
        ("no brokers", "lonely", 3, 3, True, None, False),
    )
    sizes = rows("cluster_id STRING, brokers BIGINT", ("c", 3))
    got = {r.topic: (r.decision, r.alter_config, r.refresh) for r in topology.decide(topics, sizes).collect()}
    assert got == {
        "new dynamic": ("CREATE", False, False),
        "new complete": ("CREATE", False, False),
        "new waiting": ("WAIT_CLUSTER_SIZE", False, False),
        "dynamic": ("REASSIGN", False, True),
        "even": ("REASSIGN", False, False),
        "first complete": ("REASSIGN", True, False),
        "first incomplete": ("KEEP", True, False),
        "later complete": ("KEEP", False, False),
        "broken": ("DESCRIBE_ERROR", False, False),
        "lonely": ("KEEP", False, False),
    }


def test_actions(rows):
    topics = rows(
        DECIDE,
        ("c", "up", 1, -1, False, None, False), ("c", "down", 3, -1, False, None, False),
        ("c", "new", 9, -1, False, "UNKNOWN_TOPIC_OR_PARTITION", False), ("c", "kept", 1, 5, False, None, False),
        ("c", "waiting", 0, 5, False, "UNKNOWN_TOPIC_OR_PARTITION", False),
    )
    brokers = rows(BROKERS, ("c", 10, ""), ("c", 20, ""))
    sizes = topology.replication_params(brokers)
    current = rows("cluster_id STRING, topic STRING, partition_id INT, replicas ARRAY<INT>", ("c", "kept", 0, [7, 8]), ("c", "up", 0, [1]))
    got = topology.topology_actions(topology.decide(topics, sizes), brokers, current)
    assert sorted((r.topic, r.step, r.action, r.partition_id, r.replicas) for r in got.collect()) == [
        ("down", 1, "reassign", 0, "10,20"),
        ("down", 1, "reassign", 1, "20,10"),
        ("down", 1, "reassign", 2, "10,20"),
        ("kept", 0, "keep", 0, "7,8"),
        ("new", 1, "create_topic", 0, "10,20"),
        ("new", 1, "create_topic", 1, "20,10"),
        ("up", 1, "reassign", 0, "10,20"),
        ("up", 2, "create_partitions", 1, "20,10"),
    ]


def test_orphans(rows):
    topics = rows(TOPICS, ("c", "t", 3), ("c", "none", 0), ("d", "u", 1))
    sizes = rows("cluster_id STRING, brokers BIGINT", ("c", 2))
    got = sorted((r.topic, r.partition_id, r.orphan) for r in topology.orphan_partitions(topics, sizes).collect())
    assert got == [("t", 0, False), ("t", 1, False), ("t", 2, True), ("u", 0, True)]


LEADERS = "cluster_id STRING, topic STRING, partition_id INT, leader INT"


def by_topic(df, *columns):
    return {(r.cluster_id, r.topic): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_leader_mismatch(rows):
    a = rows(
        LEADERS, ("c", "t", 0, 0), ("c", "t", 1, 1), ("c", "t", 2, 2), ("c", "same", 0, 4), ("c", "less", 0, 1), ("c", "less", 1, 1),
        ("d", "t", 0, 5), ("e", "t", 0, 6),
    )
    b = rows(
        LEADERS, ("c", "t", 0, 0), ("c", "t", 1, 1), ("c", "t", 2, 1), ("c", "same", 0, 4), ("c", "less", 0, 1), ("c", "more", 0, 1),
        ("d", "t", 0, 6), ("e", "t", 0, 6),
    )
    assert by_topic(topology.leader_mismatch(a, b), "mismatch") == {
        ("c", "t"): True, ("c", "same"): False, ("c", "less"): True, ("c", "more"): True, ("d", "t"): True, ("e", "t"): False,
    }


def test_leader_election(rows):
    parts = rows(
        LEADERS, ("c", "ok", 0, 0), ("c", "ok", 1, 1), ("c", "moved", 0, 1), ("c", "moved", 1, 0), ("c", "other size", 0, 1),
        ("d", "ok", 0, 1), ("d", "ok", 1, 0), ("d", "unknown", 0, 1),
    )
    sizes = rows(
        "cluster_id STRING, topic STRING, brokers BIGINT", ("c", "ok", 2), ("c", "moved", 2), ("c", "other size", 2), ("d", "ok", 2)
    )
    assert by_topic(topology.leader_election_needed(parts, sizes), "elect_leader") == {
        ("c", "ok"): False, ("c", "moved"): True, ("c", "other size"): False, ("d", "ok"): True, ("d", "unknown"): False,
    }


def test_reassignment(rows):
    df = rows(
        "cluster_id STRING, topic STRING, partition_id INT, adding ARRAY<INT>, removing ARRAY<INT>",
        ("c", "a", 0, [], []), ("c", "b", 0, [], []), ("c", "b", 1, [], [3]), ("d", "b", 0, [], []),
    )
    assert by_topic(topology.reassignment_ongoing(df), "ongoing") == {("c", "a"): False, ("c", "b"): True, ("d", "b"): False}


def test_coverage(rows):
    names = "cluster_id STRING, topic STRING, partition_id INT"
    expected = rows(names, ("c", "t", 0), ("c", "t", 1), ("c", "u", 0), ("d", "u", 0))
    consumed = rows(names, ("c", "t", 0), ("c", "t", 0), ("c", "t", 9), ("c", "u", 0), ("c", "x", 0))
    assert by_topic(topology.partition_coverage(expected, consumed), "expected", "seen", "covered") == {
        ("c", "t"): (2, 1, False), ("c", "u"): (1, 1, True), ("d", "u"): (1, 0, False),
    }
    assert sorted(tuple(r) for r in topology.unconsumed_partitions(expected, consumed).collect()) == [("c", "t", 1), ("d", "u", 0)]


def test_coverage_in_rows_of_bits(rows):
    """Many, negative and null partitions; a topic's partitions are reduced to a row for each 64 of them."""
    names = "cluster_id STRING, topic STRING, partition_id BIGINT"
    wide = [("c", "t", p) for p in [*range(-70, 200), 2**62, None]]
    expected = rows(names, *wide, *wide[:3], ("c", "none", None), (None, "t", 1))
    consumed = rows(names, *wide[1:-1], ("c", "none", 0), (None, "t", 1), ("c", "t", 700))
    assert by_topic(topology.partition_coverage(expected, consumed), "expected", "seen", "covered") == {
        ("c", "t"): (272, 270, False), ("c", "none"): (1, 0, False), (None, "t"): (1, 1, True),
    }
    seen = topology.partition_coverage(expected, consumed.unionByName(rows(names, wide[0], wide[-1])))
    assert by_topic(seen, "seen", "covered")["c", "t"] == (272, True)
    missing = [("c", "t", -70)] * 2 + [("c", "t", None), ("c", "none", None), (None, "t", 1)]
    got = [tuple(r) for r in topology.unconsumed_partitions(expected, consumed).collect()]
    assert Counter(got) == Counter(missing)
    bits = topology._partition_bits(expected, consumed).where("topic = 't' AND cluster_id = 'c'")
    assert bits.count() == 9


def test_round_numbers_run_on(rows):
    sizes = rows(
        "cluster_id STRING, client_id STRING, tick BIGINT, partitions BIGINT",
        ("c", "x", 10, 2), ("c", "x", 20, 0), ("c", "x", 30, 3), ("d", "x", 10, 1),
    )
    got = topology.generate_round(sizes, width=7).orderBy("cluster_id", "message_id").collect()
    assert [(r.cluster_id, r.tick, r.partition, r.message_id) for r in got] == [
        ("c", 10, 0, 1), ("c", 10, 1, 2), ("c", 30, 0, 3), ("c", 30, 1, 4), ("c", 30, 2, 5), ("d", 10, 0, 1)
    ]
    assert got[0].payload == '{"producerId":"x","messageId":1,"timestamp":10}'
    # A process that starts anew counts from 1 again.
    started = sizes.withColumn("started_ms", F.when(F.col("tick") < 30, 1).otherwise(25).cast("bigint"))
    again = topology.generate_round(started).where("tick = 30").collect()
    assert sorted(r.message_id for r in again) == [1, 2, 3]


def test_planning_shuffles(spark):
    """The chain from brokers to plans stays short."""
    from probefleet.plans.queries import registry

    most = {"broker_order": 14, "replica_plan": 18, "plan_quality": 19, "topology_actions": 20}
    for name, limit in most.items():
        plan = registry()[name](spark, "/root/testdata/sf0.001")
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        text = text[: text.find("Initial Plan")] if "Initial Plan" in text else text
        assert text.count("ShuffleQueryStage") <= limit, (name, text.count("ShuffleQueryStage"))
