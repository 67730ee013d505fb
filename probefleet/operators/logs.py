"""Latencies mined from logs: rows, means and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.operators.chunks import running_sums


def parse_log_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Kind and duration of the lines that report a latency; the first matching pattern decides.

    Strict keeps to broker ids of one digit and so passes over the connections of the others.
    """
    line = F.col("value")

    def candidate(kind: str, word: str, narrow: str, wide: str):
        # The plain word decides cheaply whether the pattern needs a try.
        digits = F.regexp_extract(line, narrow if strict else wide, 1)
        return F.struct(F.lit(kind).alias("kind"), F.when(line.contains(word), digits).otherwise("").alias("digits"))

    found = F.filter(F.array(*[candidate(*rule) for rule in C.LOG_PATTERNS]), lambda c: c["digits"] != "")
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.inline(F.slice(found, 1, 1))).select(
        *kept, "kind", F.col("digits").try_cast("bigint").alias("duration_ms")
    )


def _div(a: Column, n: int) -> Column:
    """Whole quotient of whole numbers, exact at any size."""
    return F.call_function("div", a, F.lit(n).cast("bigint"))


def latency_mean(latencies: DataFrame, keys: Sequence[str] = ("kind",), value: str = "duration_ms") -> DataFrame:
    total, n = F.sum(value), F.count(value)
    return latencies.groupBy(*keys).agg((total.cast("double") / n).alias("mean_ms"), n.alias("n"))


def latency_quantiles(
    latencies: DataFrame,
    n: int = 4,
    method: str = "exclusive",
    keys: Sequence[str] = ("kind",),
    value: str = "duration_ms",
    width: int = 4096,
) -> DataFrame:
    """The n - 1 cut points of each key, exactly; NULL for keys with fewer than two values.

    Values are counted first. A value's share in a cut point follows from the range of sorted positions
    that its copies fill, so neither raw rows nor all values of a key meet in one task.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if method not in ("exclusive", "inclusive"):
        raise ValueError(f"unknown method {method}")
    keys = list(keys)
    counts = latencies.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if n == 1:
        return counts.select(*keys, F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("q")).where(F.lit(False))
    placed = running_sums(counts, keys, value, {"_to": "_n"}, width, totals={"_size": "_n"})
    size = F.col("_size")

    def cut(i):
        """Cut point i mixes the sorted values at positions j and j + 1 (from 1) by weights of n."""
        if method == "exclusive":
            j = F.greatest(F.lit(1), F.least(size - 1, _div(i * (size + 1), n)))
            rest = i * (size + 1) - j * n
        else:
            j = _div(i * (size - 1), n) + 1
            rest = i * (size - 1) - (j - 1) * n
        return F.struct(i.alias("i"), j.alias("j"), rest.alias("rest"))

    def holds(position):
        return (position > F.col("_to") - F.col("_n")) & (position <= F.col("_to"))

    cuts = F.array(*[cut(F.lit(i).cast("bigint")) for i in range(1, n)])
    shares = placed.select(
        *keys,
        value,
        "_size",
        "_to",
        "_n",
        F.explode(F.filter(cuts, lambda c: holds(c["j"]) | holds(c["j"] + 1) | (size < 2))).alias("c"),
    )
    j, rest = F.col("c.j"), F.col("c.rest")
    share = F.when(holds(j), F.col(value) * (n - rest)).otherwise(F.lit(0)) + F.when(
        holds(j + 1), F.col(value) * rest
    ).otherwise(F.lit(0))
    return shares.groupBy(*keys, F.col("c.i").alias("i")).agg(
        F.when(F.max("_size") >= 2, F.sum(share).cast("double") / F.lit(n)).alias("q")
    )
