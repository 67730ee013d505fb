"""Counter series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C


def count_series(
    df: DataFrame,
    keys: Sequence[str],
    universe: DataFrame | None = None,
    where: Column | None = None,
    out: str = "value",
) -> DataFrame:
    """Rows per key, or those that fulfil ``where``; keys of ``universe`` start at 0.

    The universe joins the counting as rows that add nothing, so there is no join to plan.
    """
    amount = F.lit(1).cast("bigint") if where is None else F.when(where, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    rows = df.select(*keys, amount.alias(out))
    if universe is not None:
        rows = rows.unionByName(universe.select(*keys, F.lit(0).cast("bigint").alias(out)))
    return rows.groupBy(*keys).agg(F.sum(out).alias(out))


def produced_totals(attempts: DataFrame, keys: Sequence[str] = ("cluster_id", "client_id", "partition")) -> DataFrame:
    """All attempts and the failed ones."""
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("produced_total"),
        F.count_if(F.col("error").isNotNull()).alias("produced_failed_total"),
    )


def consumed_totals(records: DataFrame, keys: Sequence[str] = ("cluster_id", "client_id", "partition")) -> DataFrame:
    """All received records, redelivered and malformed ones too."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("consumed_total"))


def connection_totals(checks: DataFrame, roster: DataFrame) -> DataFrame:
    """Checks and failed checks by broker and outcome; both outcomes start at 0 for each broker of the roster."""
    keys = ("cluster_id", "broker_id", "connected")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    universe = roster.select(
        "cluster_id", "broker_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("connected"),
        zero.alias("total"), zero.alias("errors"),
    )
    seen = checks.select(*keys, one.alias("total"), F.when(F.col("connected"), zero).otherwise(one).alias("errors"))
    return (
        seen.unionByName(universe)
        .groupBy(*keys)
        .agg(F.sum("total").alias("connection_total"), F.sum("errors").alias("connection_error_total"))
    )


def error_counters(errors: DataFrame, clients: DataFrame) -> DataFrame:
    """All error counters in long form: cluster, metric, client and topic labels ('' where a metric has none).

    ``clients`` (cluster_id, client_id, topic) says which series start at 0.
    """
    rules = {step: (metric, label, retried, zero) for step, metric, label, retried, zero in C.ERROR_COUNTERS}
    counted = errors.where(F.col("step").isin(*rules) & (_chosen(rules, 2) <= F.coalesce("will_retry", F.lit(False)).cast("int")))
    ones = counted.select(*_labelled(rules, F.col("step")), F.lit(1).cast("bigint").alias("value"))
    started = [step for step, rule in rules.items() if rule[3]]
    zeros = clients.select(
        "cluster_id", "client_id", "topic", F.explode(F.array(*[F.lit(s) for s in started])).alias("step")
    ).select(*_labelled(rules, F.col("step")), F.lit(0).cast("bigint").alias("value"))
    return (
        ones.unionByName(zeros)
        .groupBy("cluster_id", "metric", "client_id", "topic")
        .agg(F.sum("value").alias("value"))
    )


def _chosen(rules: dict, i: int) -> Column:
    """Value ``i`` of the rule of a row's step."""
    pairs = [F.lit(x) for step, rule in rules.items() for x in (step, int(rule[i]) if i == 2 else rule[i])]
    return F.create_map(*pairs)[F.col("step")]


def _labelled(rules: dict, step: Column) -> list[Column]:
    by_client = [s for s, rule in rules.items() if rule[1] == "client"]
    by_topic = [s for s, rule in rules.items() if rule[1] == "topic"]
    return [
        F.col("cluster_id"),
        _chosen(rules, 0).alias("metric"),
        F.when(step.isin(*by_client), F.col("client_id")).otherwise("").alias("client_id"),
        F.when(step.isin(*by_topic), F.col("topic")).otherwise("").alias("topic"),
    ]
