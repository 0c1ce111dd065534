"""A Bloom filter of bounded size that Spark fills and Python tasks ask.

A filter names every key it was filled with and a few others, so a task that leaves out what the
filter does not name loses nothing. Its size never passes `MAX_BITS`, whatever the number of
keys; beyond, more foreign keys pass, which costs work and no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
HASHES = 4


@dataclass(frozen=True)
class Bloom:
    bits: bytes

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the 64-bit hashes the filter names."""
        bits, mask = np.frombuffer(self.bits, np.uint8), np.uint64(len(self.bits) * 8 - 1)
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        found = np.ones(len(hashes), bool)
        for i in range(HASHES):
            place = (low + np.uint64(i) * high) & mask
            found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def bloom(hashes: DataFrame, column: str = "h") -> Bloom:
    """The filter of a column of 64-bit hashes; one row per 32 bits comes to the driver."""
    size, n = MIN_BITS, hashes.count()
    while size < min(n * BITS_PER_KEY, MAX_BITS):
        size *= 2
    h = F.col(column)
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    places = hashes.select(F.explode(F.array(*[(low + high * i).bitwiseAND(size - 1) for i in range(HASHES)])).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 31 as int))")
    words = places.groupBy(F.shiftright("place", 5).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    filled = np.zeros(size // 32, dtype="<u4")
    filled[words["word"].to_numpy()] = words["bits"].to_numpy().astype("<u4")
    return Bloom(filled.tobytes())
