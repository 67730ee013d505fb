"""Configuration strings: ``k=v;k=v`` pairs and comma separated bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"^(?i)([+-]?inf(inity)?|nan)$"


def parse_pairs(text: Column) -> Column:
    """Struct (is_valid, pairs). A key given twice keeps its last value, one trailing ``;`` is allowed.

    One bad pair makes the whole text invalid, with no pairs. The empty text is valid and has none.
    """
    items = F.split(text, ";", -1)
    items = F.when(F.element_at(items, -1) == "", F.slice(items, 1, F.size(items) - 1)).otherwise(items)
    halves = F.transform(items, lambda item: F.split(item, "=", -1))
    is_valid = (text == "") | F.forall(halves, lambda kv: (F.size(kv) == 2) & (kv[0] != ""))
    pairs = F.transform(
        halves, lambda kv: F.struct(kv[0].alias("key"), F.coalesce(F.get(kv, 1), F.lit("")).alias("value"))
    )
    last = F.filter(
        pairs,
        lambda pair, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == pair["key"]
        ),
    )
    empty = F.slice(pairs, 1, 0)
    return F.struct(
        F.coalesce(is_valid, F.lit(False)).alias("is_valid"),
        F.when((text != "") & is_valid, last).otherwise(empty).alias("pairs"),
    )


def pairs_map(text: Column) -> Column:
    """The pairs as a map; NULL for the empty and for an invalid text."""
    parsed = parse_pairs(text)
    return F.when(F.size(parsed["pairs"]) > 0, F.map_from_entries(parsed["pairs"]))


def parse_float(text: Column) -> Column:
    """Double of a number text; NULL for anything that is not exactly one number."""
    number = text.try_cast("double")
    finite = F.when(text.rlike(_NUMBER) & (F.abs(number) != float("inf")), number)
    return F.when(text.rlike(_SPECIAL), number).otherwise(finite)


def parse_bounds(text: Column) -> Column:
    """Struct (is_valid, bounds) of a comma separated list; nothing is trimmed."""
    items = F.split(text, ",", -1)
    bounds = F.transform(items, parse_float)
    is_valid = F.forall(bounds, lambda b: b.isNotNull())
    return F.struct(
        F.coalesce(is_valid, F.lit(False)).alias("is_valid"),
        F.when(is_valid, bounds).otherwise(F.slice(bounds, 1, 0)).alias("bounds"),
    )
