"""Stateful streaming operators: keyed state and event-time timers.

Rows wait in their client's state until the watermark has passed, so that rows which arrive out of order by less than the
delay give what they give in order. A client has one pending timer, and its state is read and written once for each batch
and each time the timer fires, whatever the number of its rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from probefleet import constants as C
from probefleet.functions.numbers import round_half_up
from probefleet.operators.chunks import chunk_start
from probefleet.operators.status import KEYS, ring_size
from probefleet.session import ROCKSDB, workers_find_library
from probefleet.streaming.clock import with_beats

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _by_client(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    # Keyed state of this kind exists in RocksDB only.
    stream.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    workers_find_library(stream.sparkSession)
    grouped = stream.groupBy(*KEYS)
    return grouped.transformWithStateInPandas(processor, schema, "append", "EventTime")


class _Timer:
    """A client's only timer, known by its state."""

    def __init__(self, handle: StatefulProcessorHandle):
        self._handle = handle
        self._due = handle.getValueState("due", "at_ms BIGINT")

    def at_latest(self, at_ms: int) -> None:
        """Fire at at_ms, or earlier if the timer is set to an earlier time."""
        due = self._due.get()[0] if self._due.exists() else None
        if due is not None and due <= at_ms:
            return
        if due is not None:
            self._handle.deleteTimer(due)
        self._handle.registerTimer(at_ms)
        self._due.update((at_ms,))

    def fired(self) -> None:
        self._due.clear()


_SIGNAL = np.dtype([("ts", "<i8"), ("attempt", "<i8"), ("start", "?"), ("seen", "?")])
#: A client's new signals are sorted by so many, lie in state in blocks of so many, and are judged by about so many at a time.
RUN_SIGNALS, BLOCK_SIGNALS, STEP_SIGNALS = 1 << 19, 1 << 13, 1 << 16


def _in_order(parts: list[np.ndarray]) -> np.ndarray:
    signals = np.concatenate(parts) if parts else np.zeros(0, _SIGNAL)
    return signals[np.lexsort((signals["start"], signals["attempt"], signals["ts"]))]


class _Blocks:
    """A client's signals in state: sorted blocks, and an index of them. A task holds only blocks whose times overlap."""

    def __init__(self, handle: StatefulProcessorHandle):
        self._blocks = handle.getMapState("blocks", "block BIGINT", "signals BINARY")
        self._index = handle.getValueState("index", "blocks STRING")

    def index(self) -> list[list]:
        """[first time, first time without a verdict or None, signals, number] of each block, by time."""
        return json.loads(self._index.get()[0]) if self._index.exists() else []

    def put(self, index: list[list]) -> None:
        if index:
            self._index.update((json.dumps(sorted(index, key=lambda block: block[0])),))
        else:
            self._index.clear()

    def take(self, number: int) -> np.ndarray:
        signals = np.frombuffer(self._blocks.getValue((number,))[0], _SIGNAL)
        self._blocks.removeKey((number,))
        return signals

    def add(self, index: list[list], parts: list[np.ndarray]) -> list[list]:
        """The index after signals have been added as blocks of their own; a small block is filled up by them."""
        if not any(map(len, parts)):
            return index
        small = [block for block in index if block[2] < BLOCK_SIGNALS // 2]
        kept = [block for block in index if block[2] >= BLOCK_SIGNALS // 2]
        number = 1 + max((block[3] for block in index), default=0)
        signals = _in_order([*parts, *(self.take(block[3]) for block in small)])
        for at in range(0, len(signals), BLOCK_SIGNALS):
            part = signals[at : at + BLOCK_SIGNALS]
            waiting = part["ts"][~part["seen"]]
            self._blocks.updateValue((number,), (part.tobytes(),))
            kept.append([int(part["ts"][0]), int(waiting[0]) if len(waiting) else None, len(part), number])
            number += 1
        return kept


def _with_partner(signals: np.ndarray, chosen: np.ndarray, timeout_ms: int) -> np.ndarray:
    """Has a chosen start a ready signal of its attempt up to timeout_ms later, and a chosen ready signal such a start before it?"""
    times, code = np.unique(signals["ts"]), np.unique(signals["attempt"], return_inverse=True)[1]
    # Attempt and time as one number, by their ranks.
    of_attempt = code * (len(times) + 1)
    place = of_attempt + np.searchsorted(times, signals["ts"])
    found = np.zeros(len(chosen), bool)
    for start, before, after in ((True, 0, timeout_ms), (False, timeout_ms, 0)):
        own = signals["start"][chosen] == start
        mine, others = chosen[own], np.sort(place[signals["start"] != start])
        first = of_attempt[mine] + np.searchsorted(times, signals["ts"][mine] - before)
        end = of_attempt[mine] + np.searchsorted(times, signals["ts"][mine] + after, "right")
        found[own] = np.searchsorted(others, end) > np.searchsorted(others, first)
    return found


class JoinWatch(StatefulProcessor):
    """Group joins of a client: starts, ready signals, timeouts, and the end after too many timeouts in a row."""

    def __init__(self, timeout_ms: int, retries: int):
        self._timeout, self._retries = timeout_ms, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timer = _Timer(handle)
        self._open = _Blocks(handle)
        self._run = handle.getValueState("run", "timeouts BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        index, parts, held = self._open.index(), [], 0
        for frame in rows:
            part = np.zeros(len(frame), _SIGNAL)
            part["ts"], part["attempt"] = frame["ts_ms"].astype("int64"), frame["attempt"].astype("int64")
            part["start"] = frame["kind"] == "start"
            parts.append(part)
            held += len(part)
            if held >= RUN_SIGNALS:
                index, parts, held = self._open.add(index, parts), [], 0
        self._keep(self._open.add(index, parts))
        return
        yield

    def _keep(self, index: list[list]) -> None:
        self._open.put(index)
        if not index:
            return
        # The earliest signal without a verdict is due first; seen ones leave when they can match nothing any more.
        waiting = min((block[1] for block in index if block[1] is not None), default=None)
        if waiting is not None:
            self._timer.at_latest(waiting + self._timeout)
        else:
            self._timer.at_latest(min(block[0] for block in index) + 2 * self._timeout)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.fired()
        now = timerValues.getCurrentWatermarkInMs()
        index = self._open.index()
        due, later = [block for block in index if block[0] <= now], [block for block in index if block[0] > now]
        run = self._run.get()[0] if self._run.exists() else 0
        signals, at = np.zeros(0, _SIGNAL), 0
        while at < len(due):
            parts, held = [signals], 0
            while at < len(due) and held < STEP_SIGNALS:
                parts.append(self._open.take(due[at][3]))
                held += len(parts[-1])
                at += 1
            signals = _in_order(parts)
            # No block that is still in state has a signal up to here.
            upto = min(now, due[at][0] - 1) if at < len(due) else now
            chosen = np.flatnonzero(~signals["seen"] & (signals["ts"] + self._timeout <= upto))
            if len(chosen):
                run, verdicts = self._judge(key, signals, chosen, run)
                signals["seen"][chosen] = True
                if len(verdicts):
                    yield verdicts
            signals = signals[signals["ts"] + 2 * self._timeout > upto]
        self._run.update((run,))
        self._keep(self._open.add(later, [signals]))

    def _judge(self, key, signals: np.ndarray, chosen: np.ndarray, run: int) -> tuple[int, pd.DataFrame]:
        """The client's timeouts in a row after the chosen signals, which are in order of time, and the rows they give."""
        found, start = _with_partner(signals, chosen, self._timeout), signals["start"][chosen]
        # Timeouts in a row, those before the first start here included.
        joined = found[start]
        number = np.arange(len(joined))
        last = np.maximum.accumulate(np.where(joined, number, -1)) if len(joined) else number
        in_row = np.where(last >= 0, number - last, number + 1 + run)
        # The process ends after a fatal one; its successor counts anew.
        retry = np.zeros(len(chosen), np.int64)
        retry[start] = np.where(joined, 0, (in_row - 1) % (self._retries + 1) + 1)
        fatal = retry > self._retries
        if len(joined):
            run = 0 if fatal[start][-1] else int(retry[start][-1])
        told = start | ~found
        none = ~start[told]
        return run, pd.DataFrame(
            {
                "cluster_id": key[0],
                "client_id": key[1],
                "attempt": signals["attempt"][chosen][told],
                "ts_ms": signals["ts"][chosen][told],
                "kind": np.where(none, "late_ready", "attempt").astype(object),
                "timed_out": pd.arrays.BooleanArray(~found[told], none),
                "retry": pd.arrays.IntegerArray(retry[told], none),
                "fatal": pd.arrays.BooleanArray(fatal[told], none),
            }
        )

    def close(self) -> None:
        pass


JOIN_OUTCOME = "cluster_id STRING, client_id STRING, attempt BIGINT, ts_ms BIGINT, kind STRING, timed_out BOOLEAN, retry BIGINT, fatal BOOLEAN"


def watch_joins(
    events: DataFrame, delay: str, beats: DataFrame | None = None, timeout_ms: int = C.JOIN_TIMEOUT_MS, retries: int = C.JOIN_RETRIES
) -> DataFrame:
    """Outcome of each group join as soon as it is known, and ready signals that came too late for any start.

    ``events`` is a stream of (cluster_id, client_id, attempt, kind, ts_ms). A start without a ready signal within timeout_ms
    times out; ``retry`` counts a client's timeouts in a row, and one beyond ``retries`` is fatal. ``delay`` is how far out of
    order signals may arrive; later ones are dropped, and counted by the query's progress.
    """
    seen = with_beats(events.select(*KEYS, "attempt", "kind", "ts_ms"), beats, "ts_ms")
    timed = seen.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    return _by_client(timed, JoinWatch(timeout_ms, retries), JOIN_OUTCOME)


class StatusRing(StatefulProcessor):
    """The sampled counters of a client: totals, the last N samples, and the ticks that are not over yet."""

    def __init__(self, size: int, tick_ms: int):
        self._size, self._tick = size, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timer = _Timer(handle)
        # Records of open ticks, and the next tick to sample.
        self._open = handle.getValueState("open", "ticks STRING, next BIGINT")
        self._ring = handle.getListState("ring", "produced BIGINT, consumed BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        state = self._open.get() if self._open.exists() else None
        ticks, following = (json.loads(state[0]), state[1]) if state else ({}, None)
        for frame in rows:
            for tick, produced, consumed in frame[["tick", "produced", "consumed"]].itertuples(index=False, name=None):
                have = ticks.get(str(int(tick)), (0, 0))
                ticks[str(int(tick))] = (have[0] + int(produced), have[1] + int(consumed))
        first = min(map(int, ticks))
        # Until its first sample is taken, a client starts with its earliest tick.
        following = first if following is None or not self._ring.exists() else following
        self._open.update((json.dumps(ticks), following))
        self._timer.at_latest(following)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.fired()
        now = timerValues.getCurrentWatermarkInMs()
        ticks, following = self._open.get()
        ticks = json.loads(ticks)
        ring = [(r[0], r[1]) for r in self._ring.get()] if self._ring.exists() else []
        produced, consumed = ring[-1] if ring else (0, 0)
        out = []
        while following <= now:
            more = ticks.pop(str(following), None)
            produced, consumed = produced + (more or (0, 0))[0], consumed + (more or (0, 0))[1]
            ring = [*ring, (produced, consumed)][-self._size :]
            out.append((following, produced - ring[0][0], consumed - ring[0][1], len(ring), more is None))
            following += self._tick
        self._ring.put(ring)
        self._open.update((json.dumps(ticks), following))
        self._timer.at_latest(following)
        frame = pd.DataFrame(out, columns=["tick", "produced_delta", "consumed_delta", "count", "quiet"])
        frame.insert(0, "client_id", key[1])
        frame.insert(0, "cluster_id", key[0])
        yield frame

    def close(self) -> None:
        pass


_RING_ROW = "cluster_id STRING, client_id STRING, tick BIGINT, produced_delta BIGINT, consumed_delta BIGINT, count BIGINT, quiet BOOLEAN"
_PART = "cluster_id STRING, client_id STRING, tick BIGINT, produced BIGINT, consumed BIGINT"


def _added_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of one client and tick as one row, before they travel."""
    for frame in frames:
        yield frame.groupby([*KEYS, "tick"], as_index=False, sort=False, dropna=False).sum()


def watch_status(
    records: DataFrame, window_ms: int, tick_ms: int, delay: str, beats: DataFrame | None = None
) -> DataFrame:
    """Status of each client at each tick, once the watermark has passed it: deltas, count, time_window, percentage, quiet.

    ``records`` is a stream of (cluster_id, client_id, ack_ms, recv_ms), one of the times null. A client is sampled from its first
    tick on for as long as records or heartbeats move the time on, so a silent one has quiet ticks, and at last the percentage
    that stands for no data. Records of ticks that are over are dropped, and counted by the query's progress.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # A tick is named by its end.
    tick = chunk_start(F.coalesce("ack_ms", "recv_ms"), tick_ms) + F.lit(tick_ms)
    counted = records.select(
        *KEYS,
        tick.cast("bigint").alias("tick"),
        F.when(F.col("ack_ms").isNotNull(), one).otherwise(zero).alias("produced"),
        F.when(F.col("ack_ms").isNull(), one).otherwise(zero).alias("consumed"),
    )
    parts = with_beats(counted.mapInPandas(_added_up, _PART), beats, "tick")
    timed = parts.withColumn("at", F.timestamp_millis(F.col("tick") - 1)).withWatermark("at", delay)
    rows = _by_client(timed, StatusRing(ring_size(window_ms, tick_ms), tick_ms), _RING_ROW)
    share = round_half_up((F.col("consumed_delta") * 100).cast("double") / F.nullif("produced_delta", F.lit(0)), 2)
    return rows.select(
        *KEYS, "tick", "produced_delta", "consumed_delta", "count",
        (F.col("count") * F.lit(tick_ms)).alias("time_window"),
        F.coalesce(share, F.lit(C.NO_DATA_PERCENTAGE)).alias("percentage"), "quiet",
    )
