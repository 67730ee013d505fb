"""Series identity: metric name and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escape(value: Column) -> Column:
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    value = F.replace(value, F.lit("\n"), F.lit("\\n"))
    return F.replace(value, F.lit('"'), F.lit('\\"'))


def label_block(labels: Column) -> Column:
    """``{k="v",...}`` with labels by name and ``le`` last; empty without labels."""
    names = F.sort_array(F.map_keys(F.map_filter(labels, lambda k, _: k != "le")))
    names = F.concat(names, F.filter(F.array(F.lit("le")), lambda k: F.map_contains_key(labels, k)))
    parts = F.transform(names, lambda k: F.concat(k, F.lit('="'), _escape(labels[k]), F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise("")


def series_id(name: Column, labels: Column) -> Column:
    """One string for a series, fit for grouping, joining and windows."""
    return F.concat(name, label_block(labels))


def with_labels(labels: Column, more: Column) -> Column:
    """Add constant labels; a label that the series sets itself stays as it is."""
    more = F.map_filter(F.coalesce(more, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(labels, k))
    return F.map_concat(labels, more)
