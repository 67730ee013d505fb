"""Sliding status: sampled counters, the window over the last samples, the status document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.functions.numbers import percentage_text, round_half_up
from probefleet.operators.chunks import CHUNK, HOME, chunk_start, running_sums, with_border

KEYS = ("cluster_id", "client_id")
_TICKS_PER_CHUNK = 4096


def tick_increments(produced: DataFrame, consumed: DataFrame, tick_ms: int) -> DataFrame:
    """Records produced and consumed per client and tick; a tick is named by its end, in epoch ms.

    ``produced`` has (cluster_id, client_id, ack_ms), ``consumed`` (cluster_id, client_id, recv_ms).
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def tick(ms):
        return (chunk_start(F.col(ms), tick_ms) + tick_ms).alias("tick")

    sent = produced.select(*KEYS, tick("ack_ms"), one.alias("produced"), zero.alias("consumed"))
    received = consumed.select(*KEYS, tick("recv_ms"), zero.alias("produced"), one.alias("consumed"))
    return add_increments(sent.unionByName(received))


def plausible_times(rows: DataFrame, ms: str, since_ms: int, until_ms: int) -> DataFrame:
    """Rows whose time can be right: [since, until). One wrong clock would fill years of quiet ticks."""
    return rows.where((F.col(ms) >= since_ms) & (F.col(ms) < until_ms))


def implausible_times(rows: DataFrame, ms: str, since_ms: int, until_ms: int) -> DataFrame:
    """The rows that ``plausible_times`` leaves out, counted by client: too early, too late or without a time."""
    at = F.col(ms)
    early, late = F.coalesce(at < since_ms, F.lit(False)), F.coalesce(at >= until_ms, F.lit(False))
    flagged = rows.where(early | late | at.isNull())
    return flagged.groupBy(*KEYS).agg(
        F.count_if(early).alias("too_early"), F.count_if(late).alias("too_late"), F.count_if(at.isNull()).alias("no_time")
    )


def add_increments(increments: DataFrame) -> DataFrame:
    return increments.groupBy(*KEYS, "tick").agg(
        F.sum("produced").alias("produced"), F.sum("consumed").alias("consumed")
    )


def sample_runs(increments: DataFrame, tick_ms: int) -> DataFrame:
    """The sampled counters as runs: from ``tick`` on, for ``length`` ticks, the client's counters are produced and consumed.

    A silent client's last run ends with its last tick with records; a silence of any length in between is one row.
    """
    known = running_sums(
        increments.select(*KEYS, "tick", F.col("produced").alias("_p"), F.col("consumed").alias("_c")),
        KEYS,
        "tick",
        {"produced": "_p", "consumed": "_c"},
        tick_ms * _TICKS_PER_CHUNK,
        following="_next",
    )
    length = F.coalesce((F.col("_next") - F.col("tick")) / tick_ms, F.lit(1)).cast("bigint").alias("length")
    return known.select(*KEYS, "tick", length, "produced", "consumed")


def every_tick(runs: DataFrame, tick_ms: int) -> DataFrame:
    """A row for each tick of the runs, for those who ask for all."""
    tick, last = F.col("tick"), F.col("tick") + (F.col("length") - 1) * tick_ms
    width = tick_ms * _TICKS_PER_CHUNK
    step, wide = F.lit(tick_ms).cast("bigint"), F.lit(width).cast("bigint")
    # A long silence is filled piece by piece.
    pieces = F.sequence(chunk_start(tick, width), chunk_start(last, width), wide)
    inside = F.sequence(F.greatest(tick, F.col("_piece")), F.least(last, F.col("_piece") + width - tick_ms), step)
    others = [c for c in runs.columns if c not in (*KEYS, "tick", "length")]
    filled = runs.select("*", F.explode(pieces).alias("_piece"))
    return filled.select(*KEYS, F.explode(inside).alias("tick"), *others)


def accumulate(increments: DataFrame, tick_ms: int) -> DataFrame:
    """Cumulative counters at every tick from a client's first to its last, quiet ticks included."""
    return every_tick(sample_runs(increments, tick_ms), tick_ms)


def ring_runs(increments: DataFrame, window_ms: int, tick_ms: int) -> DataFrame:
    """Oldest and newest sample of the last N as runs: what ``status_ring`` gives at each of ``length`` ticks from ``tick`` on.

    The newest sample changes at a tick with records, the oldest N - 1 ticks later, so there are at most two rows for each such
    tick. Beside them stands the client's first tick, from which the number of samples follows (``ring_count``).
    """
    size = ring_size(window_ms, tick_ms)
    ends = increments.groupBy(*KEYS).agg(F.min("tick").alias("first"), F.max("tick").alias("last"))
    known = increments.join(ends, list(KEYS))
    none = F.lit(0).cast("bigint")
    # Until N samples are there, the first one is the oldest.
    falls = F.when(F.col("tick") == F.col("first"), F.col("tick")).otherwise(F.col("tick") + (size - 1) * tick_ms)
    heads = known.select(*KEYS, "tick", "first", "last", F.col("produced").alias("_ph"), F.col("consumed").alias("_ch"), none.alias("_pt"), none.alias("_ct"))
    tails = known.select(*KEYS, falls.alias("tick"), "first", "last", none.alias("_ph"), none.alias("_ch"), F.col("produced").alias("_pt"), F.col("consumed").alias("_ct"))
    changes = (
        heads.unionByName(tails).where(F.col("tick") <= F.col("last")).groupBy(*KEYS, "tick", "first", "last")
        .agg(*[F.sum(c).alias(c) for c in ("_ph", "_ch", "_pt", "_ct")])
    )
    sums = {"produced_tail": "_pt", "produced_head": "_ph", "consumed_tail": "_ct", "consumed_head": "_ch"}
    runs = running_sums(changes, KEYS, "tick", sums, tick_ms * _TICKS_PER_CHUNK, following="_next")
    length = ((F.coalesce("_next", F.col("last") + tick_ms) - F.col("tick")) / tick_ms).cast("bigint")
    return runs.select(*KEYS, "tick", length.alias("length"), "first", *sums)


def ring_count(runs: DataFrame, window_ms: int, tick_ms: int) -> DataFrame:
    """Add the number of samples in the ring at ``tick``."""
    held = F.least((F.col("tick") - F.col("first")) / tick_ms + 1, F.lit(ring_size(window_ms, tick_ms)))
    return runs.withColumn("count", held.cast("bigint")).drop("first")


def current_ring(increments: DataFrame, window_ms: int, tick_ms: int) -> DataFrame:
    """The ring of each client at its last tick with records, without a row for any other tick."""
    runs = ring_runs(increments, window_ms, tick_ms)
    columns = [c for c in runs.columns if c not in KEYS]
    last = runs.groupBy(*KEYS).agg(F.max_by(F.struct(*columns), "tick").alias("_run")).select(*KEYS, "_run.*")
    return ring_count(last.withColumn("tick", F.col("tick") + (F.col("length") - 1) * tick_ms).drop("length"), window_ms, tick_ms)


def sample_counters(produced: DataFrame, consumed: DataFrame, tick_ms: int = C.STATUS_SAMPLING_MS) -> DataFrame:
    """(cluster_id, client_id, tick, produced, consumed): the counters as each tick finds them."""
    return accumulate(tick_increments(produced, consumed, tick_ms), tick_ms)


def ring_size(window_ms: int, sampling_ms: int) -> int:
    size = window_ms // sampling_ms
    if size < 1:
        raise ValueError("the status window must span at least one sampling interval")
    return size


def status_ring(samples: DataFrame, window_ms: int, sampling_ms: int) -> DataFrame:
    """Oldest and newest sample of the last N, and how many there are.

    Samples are one per client and tick, ``sampling_ms`` apart, as ``sample_counters`` gives them.
    """
    size = ring_size(window_ms, sampling_ms)
    width = sampling_ms * max(_TICKS_PER_CHUNK, 4 * size)
    bordered = with_border(samples, "tick", width, back=(size - 1) * sampling_ms)
    ticks = W.partitionBy(*KEYS, CHUNK).orderBy("tick")
    upto = ticks.rowsBetween(W.unboundedPreceding, 0)

    def tail(column: str) -> Column:
        # The sample N - 1 ticks ago; a chunk with fewer rows so far holds the client's first one.
        return F.coalesce(F.lag(column, size - 1).over(ticks), F.first(column).over(upto))

    return (
        bordered.select(
            *KEYS,
            "tick",
            HOME,
            tail("produced").alias("produced_tail"),
            F.col("produced").alias("produced_head"),
            tail("consumed").alias("consumed_tail"),
            F.col("consumed").alias("consumed_head"),
            F.least(F.row_number().over(ticks), F.lit(size)).cast("bigint").alias("count"),
        )
        .where(HOME)
        .drop(HOME)
    )


def consumed_percentage(ring: DataFrame) -> DataFrame:
    """Consumed per produced in the window, two decimals; -1 where nothing was produced."""
    produced = F.col("produced_head") - F.col("produced_tail")
    consumed = F.col("consumed_head") - F.col("consumed_tail")
    share = round_half_up((consumed * 100).cast("double") / F.nullif(produced, F.lit(0)), 2)
    return ring.withColumn("percentage", F.coalesce(share, F.lit(C.NO_DATA_PERCENTAGE)))


def status_window(
    samples: DataFrame, window_ms: int = C.STATUS_WINDOW_MS, sampling_ms: int = C.STATUS_SAMPLING_MS
) -> DataFrame:
    """Covered window and consumed percentage at each tick."""
    return status_of_ring(status_ring(samples, window_ms, sampling_ms), sampling_ms)


def status_of_ring(ring: DataFrame, sampling_ms: int) -> DataFrame:
    return consumed_percentage(ring).select(
        *KEYS,
        "tick",
        (F.col("produced_head") - F.col("produced_tail")).alias("produced_delta"),
        (F.col("consumed_head") - F.col("consumed_tail")).alias("consumed_delta"),
        "count",
        (F.col("count") * F.lit(sampling_ms)).alias("time_window"),
        "percentage",
    )


def newest_status(status: DataFrame) -> DataFrame:
    """Each client's status at its last tick, as the status document reports it when asked."""
    columns = [c for c in status.columns if c not in (*KEYS, "tick")]
    newest = status.groupBy(*KEYS).agg(F.max_by(F.struct("tick", *columns), "tick").alias("_newest"))
    return newest.select(*KEYS, "_newest.*")


def to_status_json(status: DataFrame) -> DataFrame:
    """The status document of each tick."""
    document = F.concat(
        F.lit('{"Consuming":{"TimeWindow":'),
        F.col("time_window").cast("string"),
        F.lit(',"Percentage":'),
        percentage_text(F.col("percentage")),
        F.lit("}}"),
    )
    return status.select(*KEYS, "tick", document.alias("json"))
