"""Dashboard values from scraped counters: totals, rates, mean latencies, share under a bound."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probefleet.functions.labels import series_id
from probefleet.operators.chunks import CHUNK, last_before, with_border

FIVE_MINUTES_MS = 300000


#: Windows of a chunk.
_CHUNK_WINDOWS = 128


def evaluation_times(at: Column, reach_ms: int, step_ms: int) -> Column:
    """Times of the grid (multiples of step_ms) that see a sample: from its own on, for less than reach_ms."""
    first = at + F.pmod(-at, F.lit(step_ms))
    last = at + F.lit(reach_ms - 1) - F.pmod(at + F.lit(reach_ms - 1), F.lit(step_ms))
    step = F.lit(step_ms).cast("bigint")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))


def over_panes(
    panes: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], step_ms: int, window_ms: int, pane_ms: int
) -> DataFrame:
    """Merge panes over (at - window, at] at each time of the grid (multiples of step_ms) that sees one: (keys, at_ms, stats).

    ``panes`` has one row for each key and ``pane``, the end of a stretch of pane_ms that divides window and step. A pane is
    shuffled once, however many windows it is in; evaluation times arise where the panes of a key lie together, between one
    pane and the next. ``stats`` maps names to aggregates of the panes' columns. A long key is cut into chunks.
    """
    width = window_ms * _CHUNK_WINDOWS
    near = with_border(panes, "pane", width, back=window_ms)
    part = [*keys, CHUNK]
    following = F.lead("pane").over(W.partitionBy(*part).orderBy("pane"))
    limit = F.least(F.col(CHUNK) + width, F.coalesce("_next", F.col(CHUNK) + width))
    times = F.filter(evaluation_times(F.col("pane"), window_ms, step_ms), lambda at: (at >= F.col(CHUNK)) & (at < limit))
    columns = [c for c in panes.columns if c not in (*keys, "pane")]
    rows = near.withColumn("_next", following)
    # A row without a time of evaluation is the pane itself.
    places = F.explode(F.concat(F.array(F.lit(None).cast("bigint")), times)).alias("at_ms")
    rows = rows.select(*part, "pane", *columns, places)
    itself = F.col("at_ms").isNull()
    rows = rows.select(
        *part, "at_ms", F.coalesce("at_ms", "pane").alias("_pos"), *[F.when(itself, F.col(c)).alias(c) for c in columns]
    )
    frame = W.partitionBy(*part).orderBy("_pos").rangeBetween(pane_ms - window_ms, 0)
    merged = rows.select(*keys, "at_ms", *[c.over(frame).alias(name) for name, c in stats.items()])
    return merged.where(F.col("at_ms").isNotNull())


def _pane(step_ms: int, window_ms: int) -> tuple[int, Column]:
    """Width and end of the pane of a scrape."""
    width = gcd(step_ms, window_ms)
    at = F.col("scrape_ms")
    return width, (at + F.pmod(-at, F.lit(width))).alias("pane")


def counter_total(samples: DataFrame, step_ms: int, lookback_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """Sum over the series of a metric at each time of the grid: (name, at_ms, total).

    A series counts with its newest value of the last lookback_ms; one that is not scraped any more is left out.
    """
    width, pane = _pane(step_ms, lookback_ms)
    keys = ["name", "_series"]
    seen = samples.select("name", series_id(F.col("name"), F.col("labels")).alias("_series"), "scrape_ms", pane, "value")
    newest = seen.groupBy(*keys, "pane").agg(F.max_by("value", "scrape_ms").alias("_newest"))
    values = over_panes(newest, keys, {"value": F.last("_newest", True)}, step_ms, lookback_ms, width)
    return values.groupBy("name", "at_ms").agg(F.sum("value").alias("total"))


def counter_increase(
    samples: DataFrame, keys: Sequence[str], step_ms: int, window_ms: int = FIVE_MINUTES_MS, chunk: int | None = None
) -> DataFrame:
    """Increase of each series over (at - window, at] at each time of the grid: (keys, at_ms, increase, covered_ms).

    All series are evaluated at the same times, whenever they were scraped. covered_ms lies between the first and the
    last scrape of the window; times at which a series has fewer than two scrapes have no row. A value below its
    predecessor means that the counter started again at 0.
    """
    keys = list(keys)
    rows = samples.select(*keys, "scrape_ms", "value")
    known = last_before(rows, keys, "scrape_ms", {"_before": "value"}, chunk or window_ms * 128)
    before = F.col("_before")
    grown = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    width, pane = _pane(step_ms, window_ms)
    steps = known.select(*keys, "scrape_ms", pane, F.coalesce(grown, F.lit(0.0)).alias("_step"))
    panes = steps.groupBy(*keys, "pane").agg(
        F.sum("_step").alias("_sum"), F.min_by("_step", "scrape_ms").alias("_first_step"),
        F.min("scrape_ms").alias("_first"), F.max("scrape_ms").alias("_last"),
    )
    # The step that leads to the first scrape of a window lies outside of it.
    stats = {
        "_sum": F.sum("_sum"), "_first_step": F.first("_first_step", True), "_first": F.min("_first"), "_last": F.max("_last"),
    }
    each = over_panes(panes, keys, stats, step_ms, window_ms, width)
    increase, covered = F.col("_sum") - F.col("_first_step"), F.col("_last") - F.col("_first")
    return each.where(covered > 0).select(*keys, "at_ms", increase.alias("increase"), covered.alias("covered_ms"))


def rate_per_minute(samples: DataFrame, step_ms: int, window_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """Records per minute of each metric, all its series together: (name, at_ms, per_minute), to six decimals.

    Each series' increase is divided by the time between its scrapes.
    """
    named = samples.select("name", series_id(F.col("name"), F.col("labels")).alias("series"), "scrape_ms", "value")
    rate = F.col("increase") * F.lit(60000.0) / F.col("covered_ms")
    return (
        counter_increase(named, ["name", "series"], step_ms, window_ms)
        .groupBy("name", "at_ms")
        .agg(F.round(F.sum(rate), 6).alias("per_minute"))
    )


def _increase_ratio(
    samples: DataFrame, metric: Column, upper: Column, lower: Column, labels: Sequence[str], step_ms: int, window_ms: int
) -> tuple[DataFrame, Column]:
    """Increases of ``upper`` and ``lower`` series, each summed over the series with the same metric and labels.

    Increases are those of single series with all their labels; only then labels are left out.
    """
    part = F.when(upper, "u").when(lower, "l")
    plain = F.map_filter("labels", lambda k, _: k != "le")
    rows = samples.select(
        metric.alias("metric"),
        *[F.col("labels")[label].alias(label) for label in labels],
        series_id(F.col("name"), plain).alias("_series"),
        part.alias("_part"),
        "scrape_ms",
        "value",
    ).where(F.col("metric").isNotNull() & F.col("_part").isNotNull())
    increases = counter_increase(rows, ["metric", *labels, "_series", "_part"], step_ms, window_ms)
    sides = increases.groupBy("metric", *labels, "at_ms").agg(
        F.sum(F.when(F.col("_part") == "u", F.col("increase"))).alias("_u"),
        F.sum(F.when(F.col("_part") == "l", F.col("increase"))).alias("_l"),
    )
    return sides, F.try_divide(F.col("_u"), F.col("_l"))


def avg_latency(
    samples: DataFrame, step_ms: int, window_ms: int = FIVE_MINUTES_MS, labels: Sequence[str] = ("clientid", "partition")
) -> DataFrame:
    """Mean latency by labels over the window at each time of the grid; NULL where nothing was observed."""
    name = F.col("name")
    metric = F.nullif(F.regexp_extract(name, r"^(.*_latency)_(sum|count)$", 1), F.lit(""))
    sides, ratio = _increase_ratio(
        samples, metric, name.endswith("_latency_sum"), name.endswith("_latency_count"), labels, step_ms, window_ms
    )
    return sides.select("metric", *labels, "at_ms", ratio.alias("mean_ms"))


def share_under(
    samples: DataFrame,
    step_ms: int,
    le: str = "400",
    window_ms: int = FIVE_MINUTES_MS,
    labels: Sequence[str] = ("clientid", "partition"),
) -> DataFrame:
    """Percentage of observations up to the bound ``le``."""
    bound = F.col("labels")["le"]
    metric = F.nullif(F.regexp_extract("name", r"^(.*_latency)_bucket$", 1), F.lit(""))
    sides, ratio = _increase_ratio(samples, metric, bound == le, bound == "+Inf", labels, step_ms, window_ms)
    return sides.select("metric", *labels, "at_ms", (ratio * 100).alias("percentage"))


def scrape_growth(samples: DataFrame, width: int = FIVE_MINUTES_MS * 1024) -> DataFrame:
    """Did the series grow since the scrape before? The first scrape has nothing to compare with."""
    series = samples.select(series_id(F.col("name"), F.col("labels")).alias("series"), "scrape_ms", "value")
    return last_before(series, ["series"], "scrape_ms", {"_before": "value"}, width).select(
        "series", "scrape_ms", F.coalesce(F.col("value") > F.col("_before"), F.lit(False)).alias("grew")
    )
