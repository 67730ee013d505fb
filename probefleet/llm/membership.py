"""Sets of 64-bit hashes as Bloom filters of a bounded size, built by Spark and shipped to tasks.

A filter may let strangers through but never loses a member, so it prunes work and never decides a result. Its size follows
the number of members up to a fixed bound; beyond it more strangers pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB.
MOST_BITS = 1 << 27
_LEAST_BITS = 1 << 16
_BITS_A_MEMBER = 16
#: Which bits of a hash name its places.
_SHIFTS = (0, 18, 36)


@dataclass
class Members:
    """The filter's bits as 64-bit words; the number of bits is a power of two."""

    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """True for every member, and for a few others."""
        mask, out = np.uint64(64 * len(self.bits) - 1), np.ones(len(hashes), bool)
        for shift in _SHIFTS:
            place = (hashes.view(np.uint64) >> np.uint64(shift)) & mask
            out &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def members(hashes: DataFrame, most_bits: int = MOST_BITS) -> Broadcast[Members]:
    """The set of the only column's values, which are evenly spread 64-bit hashes (nulls are no members).

    The driver receives at most most_bits / 64 rows, however many members there are.
    """
    name = hashes.columns[0]
    size = _LEAST_BITS
    wanted = _BITS_A_MEMBER * hashes.count()
    while size < min(wanted, most_bits):
        size *= 2
    places = F.array(*(F.shiftrightunsigned(name, shift).bitwiseAND(F.lit(size - 1).cast("long")) for shift in _SHIFTS))
    words = (
        hashes.where(F.col(name).isNotNull())
        .select(F.explode(places).alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(Members(bits))
