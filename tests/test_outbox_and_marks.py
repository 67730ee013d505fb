"""The outbox publishes differences once; marks of progress have no gap and no repeat over restarts."""

import pytest
from pyspark.sql import functions as F

from probefleet.operators import status
from probefleet.session import shared_folder
from probefleet.sources import marks, outbox
from probefleet.streaming import batches

ACTION = "cluster_id STRING, topic STRING, partition_id BIGINT, step INT, action STRING, replicas STRING"
SHOWN = ["topic", "partition_id", "change", "action", "replicas", "version"]


def shown(rows):
    return sorted(tuple(r[c] for c in SHOWN) for r in rows.collect())


def test_runs_publish_their_difference(spark, rows):
    folder = shared_folder(spark, "outbox")
    first = [("c", "a", 0, 1, "reassign", "1,2"), ("c", "a", 1, 2, "create_partitions", "2,1"), ("c", "b", 0, 0, "keep", "1")]
    second = [("c", "a", 0, 1, "reassign", "1,2"), ("c", "a", 1, 2, "create_partitions", "2,3"), ("c", "d", 0, 1, "create_topic", "3")]
    assert shown(outbox.publish_actions(rows(ACTION, *first), folder, 0)) == sorted(
        (t, p, "issue", a, r, 1) for _, t, p, _, a, r in first
    )
    want = [
        ("a", 1, "issue", "create_partitions", "2,3", 2), ("b", 0, "withdraw", "keep", "1", 2), ("d", 0, "issue", "create_topic", "3", 1),
    ]
    for _ in range(2):  # a run that is repeated publishes the same
        assert shown(outbox.publish_actions(rows(ACTION, *second), folder, 1)) == want
    assert shown(outbox.publish_actions(rows(ACTION, *second), folder, 2)) == []
    assert shown(outbox.publish_actions(rows(ACTION, *second[:1]), folder, 3)) == [
        ("a", 1, "withdraw", "create_partitions", "2,3", 3), ("d", 0, "withdraw", "create_topic", "3", 2),
    ]


def test_offsets_of_sources():
    assert marks.offsets('{"logOffset":3}') == {"": 3} and marks.offsets("7") == {"": 7} and marks.offsets(None) == {}
    assert marks.offsets('{"probe":{"0":5,"1":9}}') == {"probe-0": 5, "probe-1": 9}


def test_marks_over_a_restart(spark):
    source, folder = shared_folder(spark, "source"), shared_folder(spark, "marks")
    listener = marks.ProgressMarks(spark, f"{folder}/marks")
    spark.streams.addListener(listener)
    try:
        for start in (0, 30):
            for part in range(3):
                spark.range(start + part * 10, start + part * 10 + 10).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", 1).parquet(source)
            batches.run(batches.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint"))
        # Events reach listeners a little later than the query ends.
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    found = marks.read_marks(spark, f"{folder}/marks")
    assert [(r.batch_id, r.stop, r.input_rows) for r in found.orderBy("batch_id").collect()] == [(i, i, 10) for i in range(6)]
    assert marks.gaps(found).count() == 0
    assert [r.stop for r in marks.committed(found).collect()] == [5]
    assert marks.gaps(found.where("batch_id <> 2")).count() == 1


INCREMENT = "cluster_id STRING, client_id STRING, tick BIGINT, produced BIGINT, consumed BIGINT"


@pytest.mark.parametrize("window", [10, 30, 50])
def test_runs_equal_every_tick(spark, rows, window):
    data = [("c", "x", t, t % 3, (t + 1) % 2 + 1) for t in (10, 20, 50, 60, 70, 300, 310, 900)]
    data += [("c", "y", t, 1, 0) for t in (500, 40_000)] + [("c", "z", 7000, 0, 4)]
    increments = rows(INCREMENT, *data)
    want = status.status_ring(status.accumulate(increments, 10), window, 10)
    runs = status.ring_runs(increments, window, 10)
    got = status.ring_count(status.every_tick(runs, 10), window, 10)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    # Newest row of each client, without the others.
    last = want.groupBy("client_id").agg(F.max("tick").alias("last")).collect()
    newest = {(r.client_id, r.tick): r for r in want.collect()}
    current = status.current_ring(increments, window, 10)
    assert {tuple(r) for r in current.select(columns).collect()} == {
        tuple(newest[r.client_id, r["last"]][c] for c in columns) for r in last
    }


def test_a_silent_year_is_one_row(spark, rows):
    tick, year = 30_000, 365 * 86_400_000
    increments = rows(INCREMENT, ("c", "x", tick, 5, 5), ("c", "x", tick + year, 1, 1))
    runs = status.sample_runs(increments, tick).orderBy("tick").collect()
    assert [(r.length, r.produced) for r in runs] == [(year // tick, 5), (1, 6)]
    assert status.ring_runs(increments, 300_000, tick).count() <= 3


def test_a_wrong_clock_is_one_counted_row(spark, rows):
    records = rows("cluster_id STRING, client_id STRING, recv_ms BIGINT", ("c", "x", 1000), ("c", "x", 10**15), ("c", "x", None))
    assert status.plausible_times(records, "recv_ms", 0, 10**6).count() == 1
    counted = status.implausible_times(records, "recv_ms", 0, 10**6).collect()
    assert [(r.too_early, r.too_late, r.no_time) for r in counted] == [(0, 1, 1)]
