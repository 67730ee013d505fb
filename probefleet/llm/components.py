"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet.llm.workspace import settled


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each node `a` with the lowest of itself and its neighbours `b`.

    Written, so that the join back is between plain shuffles, where Spark can split a hub's edges.
    """
    return settled(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b; longs): the lowest node that can be reached.

    Alternates two star operations until nothing changes: neighbours above a node move to its lowest neighbour, then
    neighbours below it do. A hub's edges never meet in one task: the lowest neighbour is an aggregate, and the join
    back splits where one key is large. Each round is written, so lineage stays short; the number of rounds grows with
    the logarithm of the longest path. Loops (a = b) give single nodes; nulls are ignored.
    """
    edges = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = settled(edges.distinct(), "edges")
    before = None
    while True:
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")
        ).first()
        if state == before:
            break
        before = state
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_lowest(both), "a").where("b > a or b = m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        )
        large = large.unionAll(current.where("a = b")).distinct()
        small = large.join(_lowest(large), "a")
        current = settled(
            small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .unionAll(small.select("a", F.col("m").alias("b")))
            .distinct(),
            "stars",
        )
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).groupBy("node").agg(F.min("root").alias("root"))
