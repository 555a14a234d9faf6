"""Bitmaps that tell tasks which keys are worth a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap has 16 bits or more for each entry, from 2^20 up to 2^28 bits (32 MB).
LEAST_BITS, MOST_BITS = 20, 28


class Bitmap:
    """Which keys may be members: two bits for each, in a bitmap of 2^k bits."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for half in (keys, keys << np.uint64(32)):
            at = (half >> np.uint64(64 - self.bits)).astype(np.int64)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bitmap(keys: DataFrame, rows: int) -> Bitmap:
    """The bitmap of a table's `key` (bigint, evenly spread).  It has at most 2^MOST_BITS bits, 32 MB on the driver and in each
    worker, whatever the table's size."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, rows)).bit_length()))
    high = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - bits))
    low = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("key"), F.lit(32)), F.lit(64 - bits))
    at = keys.select(F.explode(F.array(high, low)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    data = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        got = np.frombuffer(row.bits, np.uint8)
        data[row.bucket * 4096 : row.bucket * 4096 + len(got)] = got
    return Bitmap(bits, data)
