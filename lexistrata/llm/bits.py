"""A filter of keys, of a fixed size whatever their number: a bit for each hash value.

It only saves work: a key that is in is always told so, another one mostly not. The bits are united by built-in bitmap
aggregates on the map side, so that what reaches the driver is at most the filter itself.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, 16 MB.
BITS = 1 << 27
_BUCKET = 32_768


def key_filter(keys: DataFrame, column: str) -> Broadcast:
    """The filter of the longs in a column, as bytes on every worker."""
    place = F.pmod(F.col(column), F.lit(BITS)).cast("long")
    parts = keys.select((place + 1).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_m")
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        start = (row["_b"] - 1) * _BUCKET // 8
        bits[start : start + _BUCKET // 8] = np.frombuffer(bytes(row["_m"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of some longs may be in a filter."""
    place = keys.view(np.uint64) & np.uint64(BITS - 1)  # the same as pmod, as BITS is a power of two
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
