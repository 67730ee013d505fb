"""Typed configuration values, error classes, replication rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probefleet import constants as C


def int_value(text: Column, default: int) -> Column:
    """Absent: the default. Not a number: 0. Out of range: the nearest end of the range."""
    far = F.when(text.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), F.coalesce(text.try_cast("bigint"), far)).otherwise(F.lit(0))
    return F.when(text.isNull(), F.lit(default)).otherwise(number).cast("bigint")


def bool_value(text: Column, default: bool) -> Column:
    """Absent: the default. Anything but a word for true: false."""
    return F.when(text.isNull(), F.lit(default)).otherwise(text.isin(*C.TRUE_WORDS))


def is_disconnection(error_class: Column) -> Column:
    return F.coalesce(error_class.isin(*C.DISCONNECTIONS), F.lit(False))


def replication_factor(brokers: Column) -> Column:
    return F.least(brokers, F.lit(C.MAX_REPLICATION_FACTOR))


def min_in_sync(brokers: Column) -> Column:
    return F.greatest(F.lit(1), replication_factor(brokers) - 1)


def is_dynamic(expected_size: Column) -> Column:
    return expected_size == C.DYNAMIC_SIZE
