"""Counter-based random numbers: a hash of seed, stream and counters, equal wherever and however often computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def uniform(stream: str, *counters: Column, seed: int = SEED) -> Column:
    """A double in [0, 1)."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[c.cast("string") for c in counters])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
