"""Windows over long keys, split along their order.

A plain window puts all rows of a key into one task. Here a key is cut into chunks of its integral order
column. What a chunk needs of the others travels as one extra row per chunk (running sums, last values) or
as copies of the rows near its border (sliding frames). The extra rows of a key with very many chunks are cut
in turn (``levels``), so that none of their windows holds more than a block of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "_chunk"
HOME = "_home"
ROW = "_row"
#: Chunks of a block.
BLOCK = 1024
_FIRST = "_first_row"
_INNER = "_inner_chunk"


def chunk_start(order: Column, width: int) -> Column:
    return order - F.pmod(order, F.lit(width))


def _headed(chunked: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (``_row`` 1) and one header per chunk (``_row`` 0), which sorts before them."""
    rows, heads = chunked.withColumn(ROW, F.lit(1)), headers.withColumn(ROW, F.lit(0))
    return rows.unionByName(heads, allowMissingColumns=True)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    width: int,
    totals: Mapping[str, str] | None = None,
    firsts: Mapping[str, str] | None = None,
    following: str | None = None,
    levels: int = 1,
) -> DataFrame:
    """Add running sums (out -> value column) by keys along ``order``, which is unique within a key.

    ``totals`` and ``firsts`` (out -> column) add a key's whole sum and its least value on the way, and
    ``following`` names a column for the order value of the key's next row. ``levels`` above 1 is for keys of
    very many chunks.
    """
    keys, totals, firsts = list(keys), dict(totals or {}), dict(firsts or {})
    ahead = [following] if following else []
    part = [*keys, CHUNK]
    chunked = df.withColumn(CHUNK, chunk_start(F.col(order), width))
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    headers = chunked.groupBy(*part).agg(
        *[F.sum(c).alias(f"_sum_{out}") for out, c in {**sums, **totals}.items()],
        *[F.min(c).alias(f"_min_{out}") for out, c in firsts.items()],
        F.min(order).alias(_FIRST),
    )
    if levels > 1:
        inner = running_sums(
            headers.withColumnRenamed(CHUNK, _INNER),
            keys,
            _FIRST,
            {f"_add_{out}": f"_sum_{out}" for out in sums},
            width * BLOCK,
            totals={f"_key_{out}": f"_sum_{out}" for out in totals},
            firsts={f"_key_{out}": f"_min_{out}" for out in firsts},
            following=f"_key_{following}" if following else None,
            levels=levels - 1,
        )
        # The inner sums hold the chunk itself.
        own = {out: F.coalesce(f"_add_{out}", F.lit(0)) - F.coalesce(f"_sum_{out}", F.lit(0)) for out in sums}
        headers = inner.select(
            *keys,
            F.col(_INNER).alias(CHUNK),
            *[c.alias(f"_add_{out}") for out, c in own.items()],
            *[f"_key_{out}" for out in [*totals, *firsts, *ahead]],
        )
    else:
        headers = headers.select(
            *part,
            *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_add_{out}") for out in sums],
            *[F.sum(f"_sum_{out}").over(whole).alias(f"_key_{out}") for out in totals],
            *[F.min(f"_min_{out}").over(whole).alias(f"_key_{out}") for out in firsts],
            *[F.lead(_FIRST).over(whole.orderBy(CHUNK)).alias(f"_key_{out}") for out in ahead],
        )
    rows = chunked.select("*", *[F.col(c).alias(f"_add_{out}") for out, c in sums.items()])
    near = W.partitionBy(*part).orderBy(ROW, order)
    inside = near.rowsBetween(W.unboundedPreceding, 0)
    # Partitioned by chunk explicitly: rows that come partitioned by the key alone would satisfy the window
    # as they are and keep a hot key in one task.
    return (
        _headed(rows, headers)
        .repartition(*part)
        .select(
            *df.columns,
            ROW,
            *[F.sum(f"_add_{out}").over(inside).alias(out) for out in sums],
            *[F.first(f"_key_{out}").over(inside).alias(out) for out in [*totals, *firsts]],
            *[F.coalesce(F.lead(order).over(near), F.first(f"_key_{out}").over(inside)).alias(out) for out in ahead],
        )
        .where(F.col(ROW) == 1)
        .drop(ROW)
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    width: int,
    firsts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the position 1, 2, 3 ... within keys along ``order``, which is unique within a key."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sums(ones, keys, order, {out: "_one"}, width, firsts=firsts).drop("_one")


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    width: int,
    ties: Sequence[str] = (),
    levels: int = 1,
) -> DataFrame:
    """Add the last non-NULL value (out -> column) of the rows before each row of a key.

    Pass no other columns than it looks at: headers and rows then share one shuffle.
    """
    keys, ties = list(keys), list(ties)
    part = [*keys, CHUNK]
    # Partitioned first, so that headers and windows read the same shuffle and the input is computed once.
    chunked = df.withColumn(CHUNK, chunk_start(F.col(order), width)).repartition(*part)
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    # A plain order column keeps the aggregation hash-based.
    position = F.struct(order, *ties) if ties else F.col(order)
    headers = chunked.groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_end_{out}") for out, c in columns.items()],
        *([F.min(order).alias(_FIRST)] if levels > 1 else []),
    )
    if levels > 1:
        ends = {f"_past_{out}": f"_end_{out}" for out in columns}
        inner = last_before(headers.withColumnRenamed(CHUNK, _INNER), keys, _FIRST, ends, width * BLOCK, levels=levels - 1)
        headers = inner.select(*keys, F.col(_INNER).alias(CHUNK), *ends)
    else:
        headers = headers.select(*part, *[F.last(f"_end_{out}", True).over(earlier).alias(f"_past_{out}") for out in columns])
    rows = chunked.select("*", *[F.col(c).alias(f"_past_{out}") for out, c in columns.items()])
    inside = W.partitionBy(*part).orderBy(ROW, order, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        _headed(rows, headers.repartition(*part))
        .select(*df.columns, ROW, *[F.last(f"_past_{out}", True).over(inside).alias(out) for out in columns])
        .where(F.col(ROW) == 1)
        .drop(ROW)
    )


def with_border(df: DataFrame, order: str, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Copy rows into each chunk that looks ``back`` or ``ahead`` at them; ``_home`` marks a row's own chunk."""
    if width <= back + ahead:
        raise ValueError("a chunk must be wider than the frame")
    own = chunk_start(F.col(order), width)
    first = chunk_start(F.col(order) - F.lit(ahead), width)
    last = chunk_start(F.col(order) + F.lit(back), width)
    return df.select("*", F.explode(F.sequence(first, last, F.lit(width).cast("bigint"))).alias(CHUNK)).withColumn(
        HOME, F.col(CHUNK) == own
    )
