"""Numbers and running sums over a whole table's order, without a task that sees all of it.

Rows are dealt to tasks by ranges of the order; each task numbers or sums its own, and the ranges before it are added as
an offset: a row for each range (and key) is all that the driver sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.sources.shared import written

#: The column with the number of a row's range.
RANGE = "__range"


def ranged(df: DataFrame, order: list) -> DataFrame:
    """df, written, with the number of the range of the order that a row is in."""
    cols = {f"__order{i}": c for i, c in enumerate(F.col(o) if isinstance(o, str) else o for o in order)}
    dealt = df.withColumns(cols).repartitionByRange(*cols)
    return written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 0; the order must tell all rows apart."""
    t = ranged(df, order)
    at, offsets = 0, []
    for r in sorted(t.groupBy(RANGE).agg(F.count("*").alias("n")).collect(), key=lambda r: r[RANGE]):  # a row for each range
        offsets.append((r[RANGE], at))
        at += r.n
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{RANGE} int, __before long"))
    helpers = [c for c in t.columns if c.startswith("__order")]
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*helpers)) - 1
    return t.join(known, RANGE).withColumn(name, F.col("__before") + place).drop(RANGE, "__before", *helpers)


def numbered_within(df: DataFrame, keys: list[str], order: list, name: str = "place", size: str = "size") -> DataFrame:
    """df with each row's place among the rows of its keys, from 0, and their number; for few keys with many rows each."""
    t = written(numbered(df, [*keys, *order], name), "numbered")
    first = t.groupBy(*keys).agg(F.min(name).alias("__first"), F.count("*").alias(size))  # a row for each of the few keys
    return t.join(F.broadcast(first), keys).withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def running(df: DataFrame, order: str, sums: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with run_<c> and total_<c> for each c of sums: sums over the rows of the same keys up to this one, and over all.

    The order must tell rows of the same keys apart.
    """
    keys = keys or []
    t = ranged(df, [*keys, order])
    total, offsets = {}, []
    per = t.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(c) for c in sums]).collect()  # a row for each range, and for each key
    for r in sorted(per, key=lambda r: r[RANGE]):
        key = tuple(r[k] for k in keys)
        before = total.get(key, [0] * len(sums))
        offsets.append((*key, r[RANGE], *map(float, before)))
        total[key] = [x + (r[c] or 0) for x, c in zip(before, sums, strict=True)]
    rows = [(*o, *map(float, total[o[: len(keys)]])) for o in offsets]
    kinds = [f"{k} {t.schema[k].dataType.simpleString()}" for k in keys]
    known = F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join([*kinds, f"{RANGE} int", *(f"__before_{c} double" for c in sums), *(f"total_{c} double" for c in sums)])))
    w = Window.partitionBy(*keys, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = t.join(known, [*keys, RANGE]).withColumns({f"run_{c}": F.col(f"__before_{c}") + F.sum(c).over(w) for c in sums})
    return out.drop(RANGE, *(f"__before_{c}" for c in sums), *(c for c in t.columns if c.startswith("__order")))
