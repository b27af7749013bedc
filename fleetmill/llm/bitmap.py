"""A Bloom filter of 64-bit hashes of bounded size, built by Spark and shipped to tasks as one array of longs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits: 16 MB. A fuller filter only lets more pass to the exact join behind it.
MOST_BITS = 1 << 27


def build(hashes: DataFrame, name: str, n: int, per: int = 16) -> np.ndarray:
    """The filter of a column of longs (already mixed hashes), per to 2 * per bits for each of n; two bits are set for each."""
    bits = min(MOST_BITS, 1 << (per * max(n, 64)).bit_length())
    h = F.col(name)
    at = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.where(h.isNotNull()).select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be in the filter."""
    last = np.uint64(len(bitmap) * 64 - 1)
    six, low = np.uint64(6), np.uint64(63)

    def has(x: np.ndarray) -> np.ndarray:
        x = x & last
        return (bitmap[x >> six] >> (x & low)) & np.uint64(1) == 1

    found = has(h)
    at = np.flatnonzero(found)
    found[at] = has(h[at] >> np.uint64(32))
    return found
