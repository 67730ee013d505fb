"""Rounding and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Round a non-negative double on its binary value."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def bound_text(bound: float) -> str:
    """Text of a histogram bound: no decimals where it is whole."""
    return str(int(bound)) if bound == int(bound) else repr(bound)


def percentage_text(x: Column) -> Column:
    """JSON number of a value with at most two decimals."""
    return F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")


def sample_text(x: Column) -> Column:
    """Number text of a metric sample: shortest digits, exponent form from a million on."""
    size = F.abs(x)
    digits = F.regexp_replace(F.split(x.cast("string"), "E")[0], r"[.\-]", "")
    digits = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    rest = F.substr(digits, F.lit(2))
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    java = F.split(x.cast("string"), "E")
    whole = F.length(F.split(F.regexp_replace(java[0], "-", ""), r"\.")[0]) - 1
    # Plain below 1e-3 has no leading digits to count: such values carry an E already.
    exponent = F.coalesce(F.try_element_at(java, F.lit(2)).cast("int"), F.lit(0)) + whole
    sign = F.when(x < 0, "-").otherwise("")
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(exponent)))
    tiny = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), F.abs(exponent) - 1), digits)
    return (
        F.when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.concat(F.when(x > 0, "+").otherwise("-"), F.lit("Inf")))
        .when(x == 0, "0")
        .when((size >= 1e6) | (size < 1e-4), F.concat(sign, mantissa, power))
        .when(size < 1e-3, tiny)
        .when(x == F.floor(x), F.floor(x).cast("string"))
        .otherwise(x.cast("string"))
    )
