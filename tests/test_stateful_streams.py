"""Stateful streams over files out of time order give what the batch operators give, whatever the micro-batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from probefleet.operators import reconcile, roster, status
from probefleet.session import shared_folder
from probefleet.streaming import batches, clock, stateful
from probefleet.streaming.levels import Levels, merge_levels, sum_levels
from probefleet.streaming.matching import Matching

TICK = 10_000
WINDOW = 50_000


def files(spark, rows, schema, parts):
    """The rows in several files; each file is a micro-batch."""
    folder = shared_folder(spark, "source")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.schema(schema).parquet(folder)


def listed(df, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def drain(spark, build, beats_at):
    """Rows of a stream that is driven by heartbeats."""
    folder = shared_folder(spark, "drained")
    for at in beats_at:
        clock.beat(spark, f"{folder}/beats", at)
        stream = build(clock.landed_beats(spark, f"{folder}/beats"))
        batches.run(batches.write_batches(stream, f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch_id=*")


JOIN_SCHEMA = "cluster_id STRING, client_id STRING, attempt BIGINT, kind STRING, ts_ms BIGINT"


@pytest.fixture(scope="module")
def signals():
    draw, rows = random.Random(4), []
    for attempt in range(240):
        client, start = f"x{attempt % 4}", (1 + draw.randrange(400)) * 10_000
        rows.append(("c", client, attempt, "start", start))
        # Early, in time, exactly at the limit, late, twice, or never.
        for delay in draw.choice([[0], [5000], [30000], [30001], [59999], [1000, 90000], [], []]):
            rows.append(("c", client, attempt, "ready", start + delay))
    draw.shuffle(rows)
    return rows


def outcomes(rows, timeout=30000, retries=3):
    starts = [(k[:3], ts) for *k, kind, ts in rows if kind == "start"]
    ready = [(k[:3], ts) for *k, kind, ts in rows if kind == "ready"]
    out = []
    for client in sorted({(k[0], k[1]) for k, _ in starts}):
        run = 0
        for ts, attempt in sorted((ts, k[2]) for k, ts in starts if (k[0], k[1]) == client):
            joined = any(k == [*client, attempt] and ts <= r <= ts + timeout for k, r in ready)
            run = 0 if joined else run + 1
            out.append((*client, attempt, ts, "attempt", not joined, run, run > retries))
            run = 0 if run > retries else run
    for key, r in ready:
        if not any(k == key and ts <= r <= ts + timeout for k, ts in starts):
            out.append((*key, r, "late_ready", None, None, None))
    return sorted(map(str, out))


COLUMNS = ["cluster_id", "client_id", "attempt", "ts_ms", "kind", "timed_out", "retry", "fatal"]


def test_join_outcomes_over_files_out_of_order(spark, signals):
    stream, table = files(spark, signals, JOIN_SCHEMA, 4)
    got = drain(spark, lambda beats: stateful.watch_joins(stream, "2 hours", beats), [0, 10**8])
    want = outcomes(signals)
    assert listed(got, COLUMNS) == want
    assert sum("True)" in w for w in want) > 2 and sum("late_ready" in w for w in want) > 20
    joins = got.where("kind = 'attempt'").groupBy("cluster_id", "client_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("timed_out").alias("timeouts")
    )
    columns = ["client_id", "attempts", "timeouts"]
    assert listed(joins, columns) == listed(roster.join_timeouts(table), columns)


def test_a_timeout_is_known_without_its_ready_signal(spark):
    """The row comes when the time has passed, not when the signal comes; the signal then counts apart."""
    rows = [("c", "x", 1, "start", 5000), ("c", "y", 2, "start", 100_000), ("c", "x", 1, "ready", 100_001), ("c", "y", 3, "start", 300_000)]
    stream, _ = files(spark, rows, JOIN_SCHEMA, 4)
    got = drain(spark, lambda beats: stateful.watch_joins(stream, "0 seconds", beats), [-1000])
    assert listed(got.where("client_id = 'x'"), ["attempt", "kind", "timed_out"]) == ["(1, 'attempt', True)", "(1, 'late_ready', None)"]
    assert listed(got.where("client_id = 'y'"), ["attempt", "kind", "timed_out"]) == ["(2, 'attempt', True)"]


class Held:
    """State of one client in memory, as the operator sees it; counts the bytes of the greatest value."""

    def __init__(self):
        self.values, self.most = {}, 0

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, key_schema, schema):
        return Value(self, name)

    def registerTimer(self, at_ms):
        self.due = at_ms

    def deleteTimer(self, at_ms):
        self.due = None


class Value:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held.values

    def get(self):
        return self.held.values[self.name]

    def update(self, value):
        self.held.values[self.name] = value
        self.held.most = max([self.held.most, *(len(x) for x in value if isinstance(x, str | bytes))])

    def clear(self):
        self.held.values.pop(self.name, None)

    def getValue(self, key):
        return self.held.values[self.name, key]

    def updateValue(self, key, value):
        self.held.values[self.name, key] = value
        self.held.most = max(self.held.most, len(value[0]))

    def removeKey(self, key):
        del self.held.values[self.name, key]


class Watermark:
    def __init__(self, at_ms):
        self.at_ms = at_ms

    def getCurrentWatermarkInMs(self):
        return self.at_ms


@pytest.mark.parametrize("steps", [(5000, 64, 256), (97, 16, 40), (1 << 19, 1 << 13, 1 << 16)])
def test_a_clients_signals_lie_in_small_blocks(monkeypatch, steps):
    """One client's whole history in one batch, and in batches with a watermark between, is never one value of state."""
    for name, size in zip(("RUN_SIGNALS", "BLOCK_SIGNALS", "STEP_SIGNALS"), steps, strict=True):
        monkeypatch.setattr(stateful, name, size, raising=False)
    draw, rows = random.Random(9), []
    for attempt in range(4000):
        start = draw.randrange(900) * 10_000
        rows.append(("c", "x", attempt // 2, "start", start))
        rows += [("c", "x", attempt // 2, "ready", start + d) for d in draw.choice([[0], [30000], [30001], [1000, 90000], [], [], []])]
    draw.shuffle(rows)
    for cuts in ([9_000_000], [1, 1_000_000, 1_000_001, 1_030_000, 4_000_000, 9_000_000]):
        held, got, low = Held(), [], 0
        for upto in [*cuts, 10**8]:
            batch = [r for r in rows if low <= r[4] < upto]
            frame = pd.DataFrame(batch, columns=["cluster_id", "client_id", "attempt", "kind", "ts_ms"])
            watch = stateful.JoinWatch(30_000, 3)
            watch.init(held)
            list(watch.handleInputRows(("c", "x"), (frame[i : i + 50] for i in range(0, len(frame), 50)), None))
            low = upto
            while held.due is not None and held.due < upto:
                held.due = None
                got += list(watch.handleExpiredTimer(("c", "x"), Watermark(upto - 1), None))
        told = pd.concat(got).astype(object)
        told = told.where(told.notna(), None)
        assert sorted(str(tuple(r)) for r in told[COLUMNS].itertuples(index=False)) == outcomes(rows)
        assert held.most <= max(18 * steps[1], 20_000) and [k for k in held.values if k != "run"] == []


RECORD = "cluster_id STRING, client_id STRING, ack_ms BIGINT, recv_ms BIGINT"


@pytest.fixture(scope="module")
def records():
    draw, rows = random.Random(6), []
    for i in range(500):
        at = draw.randrange(40) * 7000 + (300_000 if i % 5 == 0 else 0)
        rows.append(("c", f"x{i % 3}", at, None))
        if draw.random() < 0.8:
            rows.append(("c", f"x{i % 3}", None, at + draw.randrange(9000)))
    draw.shuffle(rows)
    return rows


STATUS = ["cluster_id", "client_id", "tick", "produced_delta", "consumed_delta", "count", "time_window", "percentage"]


@pytest.mark.parametrize("parts", [1, 5])
def test_status_of_keyed_state(spark, records, parts):
    stream, table = files(spark, records, RECORD, parts)
    last = max(x for r in records for x in r[2:] if x is not None)
    end = last - last % TICK + TICK
    got = drain(spark, lambda beats: stateful.watch_status(stream, WINDOW, TICK, "1 hour", beats), [0, end + 3_600_000 + 1])
    samples = status.sample_counters(table.where("ack_ms is not null"), table.where("recv_ms is not null"), TICK)
    want = status.status_window(samples, WINDOW, TICK)
    active = got.where("not quiet").groupBy("client_id").agg(F.max("tick").alias("last"))
    assert listed(got.join(active, "client_id").where("tick <= last"), STATUS) == listed(want, STATUS)


def test_ring_of_the_last_samples(spark):
    """Values 1 to 6 put one at a time: five samples of 2 s in a window of 10 s, then the oldest goes."""
    rows = [("c", "x", i * 2000 + 1, None) for i in range(6)]
    stream, _ = files(spark, rows, RECORD, 6)
    got = drain(spark, lambda beats: stateful.watch_status(stream, 10_000, 2000, "0 seconds", beats), [0, 12_001])
    assert [(r["count"], r["produced_delta"]) for r in got.orderBy("tick").collect()] == [
        (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (5, 4),
    ]


def test_three_silent_ticks_give_documents(spark):
    rows = [("c", "x", 1000, None), ("c", "x", None, 1500), ("c", "x", 11_000, None)]
    stream, _ = files(spark, rows, RECORD, 1)
    # A window of two ticks: after the second silent one nothing was produced in it.
    beats_at = [0, 20_001, 30_001, 40_001, 50_001]
    got = drain(spark, lambda beats: stateful.watch_status(stream, 20_000, TICK, "0 seconds", beats), beats_at)
    seen = [(r.tick, r.quiet, r.percentage) for r in got.orderBy("tick").collect()]
    assert seen == [(10_000, False, -1.0), (20_000, False, 0.0), (30_000, True, -1.0), (40_000, True, -1.0), (50_000, True, -1.0)]
    documents = status.to_status_json(got).orderBy("tick").collect()
    assert documents[-1].json == '{"Consuming":{"TimeWindow":20000,"Percentage":-1}}'


def test_live_beats_are_times(spark):
    assert clock.live_beats(spark).schema.simpleString() == "struct<at_ms:bigint>"


SENT = "cluster_id STRING, client_id STRING, partition INT, message_id BIGINT, create_ms BIGINT"
BACK = "cluster_id STRING, producer_id STRING, message_id BIGINT, timestamp BIGINT, recv_ms BIGINT"
MATCHED = ["cluster_id", "client_id", "partition", "message_id", "received", "copies", "first_recv_ms"]


@pytest.mark.parametrize("delay, late", [("3 hours", False), ("1 minute", True)])
def test_matches_over_files_out_of_order(spark, delay, late):
    draw, sent, back = random.Random(8), [], []
    for i in range(400):
        at = (1 + draw.randrange(2 * 3600)) * 1000
        sent.append(("c", f"x{i % 3}", i % 2, i // 2, at))
        for copy in range(draw.choice([0, 1, 1, 2])):
            # Clocks differ by a little, and some copies come after any bound.
            back.append(("c", f"x{i % 3}", i // 2, at, at + draw.choice([-500, 20, 900, 40_000_000]) + copy))
    draw.shuffle(sent)
    draw.shuffle(back)
    produced, sent_table = files(spark, sent, SENT, 4)
    decoded, back_table = files(spark, back, BACK, 3)
    match = Matching(shared_folder(spark, "matching"), delay, within="1 hour", early="1 second")
    match.land(produced, decoded)
    beats = shared_folder(spark, "beats")
    for at in (0, 10**9):
        clock.beat(spark, beats, at)
        match.join(produced, decoded, clock.landed_beats(spark, beats))
    want = listed(reconcile.reconcile(sent_table, back_table), MATCHED)
    assert listed(match.result(spark), MATCHED) == want
    # Copies beyond the bound are late for the join; with a short delay so are rows of files that come too late.
    lost = match.late(spark).agg(F.sum("late_messages").alias("messages"), F.sum("late_copies").alias("copies")).first()
    assert (lost.messages > 0) == late and lost.copies > 0


def test_levels_add_up_and_write_little(spark):
    """Tenfold the table: the runs that a batch writes without a merge stay as small as its part."""
    table = sum_levels(shared_folder(spark, "levels"), ["k"], ["long"], {"n": "long"}, fanout=3)
    written = []
    for batch in range(14):
        part = spark.range(batch * 10, batch * 10 + 20).selectExpr("id as k", "1L as n")
        before = table.manifest(spark, batch - 1)
        runs = table.add(part, batch)
        assert table.add(part, batch) == runs  # a batch that runs again replaces what it wrote
        assert all(sum(level == at for level, _ in runs) < 3 for at in range(4))
        new = [r for r in runs if r not in before]
        written.append(sum(spark.read.parquet(table._run(r)).count() for r in new if r[0] == 0))
        assert table.last(spark) == batch
    assert set(written) <= {0, 20}
    got = {r.k: r.n for r in table.current(spark, 13).collect()}
    assert got == {k: sum(b * 10 <= k < b * 10 + 20 for b in range(14)) for k in range(150)}
    assert table.current(spark, -1).count() == 0
    # Rows written for all batches: each row once for each level, not once for each batch.
    assert len(table.manifest(spark, 13)) <= 6


def test_levels_of_a_stream_equal_one_sum(spark, records):
    stream, whole = files(spark, records, RECORD, 7)
    folder = shared_folder(spark, "stream-levels")

    def count(batch):
        return batch.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))

    def add(parts):
        return parts.groupBy("client_id").agg(F.sum("n").alias("n"))

    table = Levels(f"{folder}/table", ("client_id",), add(count(whole)).schema, add, fanout=3)
    last = batches.run(merge_levels(stream, table, f"{folder}/checkpoint", count))
    assert last == 6
    assert listed(table.current(spark, last), ["client_id", "n"]) == listed(count(whole), ["client_id", "n"])
