"""The registered streaming queries: each drains a stream of the data folder into a table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.operators import latency, status
from probefleet.plans import fixtures as fx
from probefleet.session import shared_folder
from probefleet.streaming import batches, clock, stateful
from probefleet.streaming import operators as ops
from probefleet.streaming.levels import Levels, merge_levels
from probefleet.streaming.matching import Matching

COUNT_KEYS = ("cluster_id", "client_id", "partition")
CLIENT = ["cluster_id", "client_id"]
WINDOW_MS = fx.DAY_MS
TICK_MS = fx.HOUR_MS
STATUS_MS = 10 * fx.HOUR_MS
#: How far out of order records may arrive at the stateful operators.
DELAY_MS, DELAY = 6 * fx.HOUR_MS, "6 hours"
SILENT_TICKS = 3
#: A micro-batch takes this many files at most; later ones wait for the next.
FILES_PER_BATCH = 64


def stream_table(t, name: str) -> DataFrame:
    """A table's files as a stream. The pattern admits a single file as well as a folder of files."""
    path = f"{t.sf_dir}/{name}.parque[t]"
    return t.spark.readStream.schema(t.raw(name).schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def _probes(t) -> DataFrame:
    return fx.probes(stream_table(t, "events"))


def _current(t, purpose: str, stream: DataFrame, keys, prepare, merge) -> DataFrame:
    """The current table after the last batch of a stream, kept as sorted runs."""
    folder = shared_folder(t.spark, purpose)
    table = Levels(f"{folder}/table", tuple(keys), merge(prepare(stream)).schema, merge)
    return table.current(t.spark, batches.run(merge_levels(stream, table, f"{folder}/checkpoint", prepare)))


def stream_records_consumed(t) -> DataFrame:
    """Consume counters as a current table that each batch adds to."""
    current = _current(
        t,
        "records-consumed",
        fx.consume_records(_probes(t)),
        COUNT_KEYS,
        lambda batch: ops.partial_counts(batch, COUNT_KEYS),
        lambda parts: ops.merge_counts(parts, COUNT_KEYS),
    )
    return current.withColumnRenamed("value", "consumed_total")


def stream_records_periodic(t) -> DataFrame:
    """Consume counters of a query that runs on the timer of the status job, stopped once it has caught up."""
    folder = shared_folder(t.spark, "records-periodic")
    stream = fx.consume_records(_probes(t))
    prepare, merge = lambda batch: ops.partial_counts(batch, COUNT_KEYS), lambda parts: ops.merge_counts(parts, COUNT_KEYS)
    table = Levels(f"{folder}/table", COUNT_KEYS, prepare(stream).schema, merge)
    query = merge_levels(stream, table, f"{folder}/checkpoint", prepare, batches.trigger("status"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return table.current(t.spark, table.last(t.spark)).withColumnRenamed("value", "consumed_total")


def stream_latency_hist(t) -> DataFrame:
    """Daily end-to-end histograms as a current table of their parts."""
    rows = latency.with_e2e_latency(latency.decode_records(fx.consume_records(_probes(t))))
    keys = [*CLIENT, "window_ms"]
    parts = _current(
        t,
        "latency-hist",
        rows,
        keys,
        lambda batch: ops.partial_histogram(batch, "latency_ms", "recv_ms", CLIENT, C.END_TO_END_BOUNDS, WINDOW_MS),
        lambda parts: ops.add_histograms(parts, keys, C.END_TO_END_BOUNDS),
    )
    return ops.merge_histograms(parts, CLIENT, C.END_TO_END_BOUNDS)


def _tick_stream(t) -> DataFrame:
    none = F.lit(None).cast("bigint")
    produced = fx.produce_attempts(_probes(t)).select(*CLIENT, F.col("ack_ms"), none.alias("recv_ms"))
    consumed = fx.consume_records(_probes(t)).select(*CLIENT, none.alias("ack_ms"), "recv_ms")
    return produced.unionByName(consumed)


def _status_rows(t, silent: int = 0, sink=None) -> DataFrame:
    """Status rows of all ticks up to the last one of any client, and of ``silent`` ticks more, from keyed state.

    Heartbeats end the stream: the first lies before all records, the last closes the ticks that are still open.
    """
    folder = shared_folder(t.spark, "status")
    beats, rows = f"{folder}/beats", f"{folder}/rows"
    probes = fx.probes(t.raw("events"))
    ends = fx.produce_attempts(probes).select(F.col("ack_ms").alias("ms")).unionByName(
        fx.consume_records(probes).select(F.col("recv_ms").alias("ms"))
    )
    last = ends.agg(F.max("ms")).first()[0] or 0
    end = last - last % TICK_MS + (1 + silent) * TICK_MS
    for at in (0, end + DELAY_MS + 1):
        clock.beat(t.spark, beats, at)
        stream = stateful.watch_status(_tick_stream(t), STATUS_MS, TICK_MS, DELAY, clock.landed_beats(t.spark, beats))
        if sink:
            batches.run(merge_levels(stream, sink(stream, folder), f"{folder}/checkpoint", lambda batch: batch))
        else:
            batches.run(batches.write_batches(stream, rows, f"{folder}/checkpoint"))
    if sink:
        table = sink(stream, folder)
        return table.current(t.spark, table.last(t.spark))
    return t.spark.read.schema(stream.schema).parquet(f"{rows}/batch_id=*")


def stream_status(t) -> DataFrame:
    """Status at each tick from a client's first to its last with records, kept by keyed state."""
    rows = _status_rows(t)
    active = rows.where(~F.col("quiet")).groupBy(*CLIENT).agg(F.max("tick").alias("_last"))
    return rows.join(active, CLIENT).where(F.col("tick") <= F.col("_last")).drop("_last", "quiet")


def stream_status_ticks(t) -> DataFrame:
    """Status documents of all ticks, three silent ones at the end included."""
    return status.to_status_json(_status_rows(t, SILENT_TICKS))


def stream_status_current(t) -> DataFrame:
    """The newest status document of each client from a tick with records, as a current table."""

    def newest(rows: DataFrame) -> DataFrame:
        return status.newest_status(rows.where(~F.col("quiet")))

    def sink(stream: DataFrame, folder: str) -> Levels:
        return Levels(f"{folder}/current", tuple(CLIENT), stream.schema, newest)

    return status.to_status_json(_status_rows(t, sink=sink))


def stream_reconcile(t) -> DataFrame:
    """Produced messages and their copies, joined as streams; hours with late rows are matched again.

    Malformed records match nothing and stay behind.
    """
    folder = shared_folder(t.spark, "reconcile")
    beats = f"{folder}/beats"
    match = Matching(folder, DELAY, within=DELAY, early="1 minute")
    last = fx.probes(t.raw("events")).agg(F.max("ms")).first()[0] or 0
    produced = fx.produce_attempts(_probes(t))
    decoded = latency.decode_records(fx.consume_records(_probes(t))).where(~F.col("is_malformed"))
    match.land(produced, decoded)
    for at in (0, last + 4 * DELAY_MS):
        clock.beat(t.spark, beats, at)
        match.join(produced, decoded, clock.landed_beats(t.spark, beats))
    return match.result(t.spark).drop("create_ms")


def _join_outcomes(t) -> DataFrame:
    folder = shared_folder(t.spark, "join-outcomes")
    beats, rows = f"{folder}/beats", f"{folder}/rows"
    last = fx.join_events(t.raw("orders")).agg(F.max("ts_ms")).first()[0] or 0
    for at in (0, last + DELAY_MS + 3 * C.JOIN_TIMEOUT_MS):
        clock.beat(t.spark, beats, at)
        events = fx.join_events(stream_table(t, "orders"))
        stream = stateful.watch_joins(events, DELAY, clock.landed_beats(t.spark, beats))
        batches.run(batches.write_batches(stream, rows, f"{folder}/checkpoint"))
    return t.spark.read.schema(stream.schema).parquet(f"{rows}/batch_id=*")


def stream_join_outcomes(t) -> DataFrame:
    """Each group join with its outcome, and ready signals that came too late."""
    return _join_outcomes(t)


def stream_join_timeouts(t) -> DataFrame:
    """Group joins and timeouts of each client, from the outcomes."""
    joins = _join_outcomes(t).where("kind = 'attempt'")
    return joins.groupBy(*CLIENT).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("timed_out").alias("timeouts"))


STREAMS = (
    stream_records_consumed,
    stream_records_periodic,
    stream_latency_hist,
    stream_status,
    stream_status_ticks,
    stream_status_current,
    stream_reconcile,
    stream_join_outcomes,
    stream_join_timeouts,
)
