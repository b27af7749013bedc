"""Exact quantiles without a buffer of all values: selection by counted value ranges, then ranks in the ranges that matter.

Values are counted, the counts dealt to tasks by ranges of (keys, value), and each range's counts added up. That tells in
which range a quantile's two neighbours lie; only the rows of those ranges are put in order and cumulated. No task holds
more than a range, the driver none of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.functions.columns import col
from fleetmill.operators.ordering import RANGE, ranged
from fleetmill.sources.shared import written

#: Rows (a key's range that holds a quantile) that may be broadcast; about 100 bytes each.
WANTED_ROWS = 100_000


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, n: x & a[n].eqNullSafe(b[f"__k_{n}"]), names, F.lit(True))


def quantiles(df: DataFrame, value: Column | str, wanted: dict[str, float], keys: list[str] | None = None, weight: Column | str | None = None) -> DataFrame:
    """(keys, a column for each wanted quantile), linear between neighbours; a value counts `weight` (a whole number) times.

    Nulls are left out; a key without values keeps its row, with nulls. Without keys there is one row.
    """
    keys = keys or []
    w = F.when(F.col("__v").isNotNull(), col(weight) if weight is not None else F.lit(1)).otherwise(0)
    counts = df.withColumn("__v", col(value).cast("double")).groupBy(*keys, "__v").agg(F.sum(w).cast("long").alias("__n")).where("__n > 0 or __v is null")
    t = ranged(counts, [*keys, "__v"])
    per = t.groupBy(*keys, RANGE).agg(F.sum("__n").alias("__in"))  # a row for each range and key
    key = Window.partitionBy(*keys)
    up = key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"__before": F.sum("__in").over(up) - F.col("__in"), "__total": F.sum("__in").over(key)})
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("__total") - 1)).alias("at")) for name, p in wanted.items()])).alias("q")
    per = per.select(*keys, RANGE, "__in", "__before", places)
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), f("q.at").cast("long").alias("rank")) for side, f in (("lo", F.floor), ("hi", F.ceil))])).alias("s")
    per = per.select(*[F.col(k).alias(f"__k_{k}") for k in [*keys, RANGE]], "__before", "__in", F.col("q.name").alias("__name"), F.col("q.at").alias("__at"), sides)
    per = per.where((F.col("s.rank") >= F.col("__before")) & (F.col("s.rank") < F.col("__before") + F.col("__in"))).select("*", F.col("s.side").alias("__side"), (F.col("s.rank") - F.col("__before")).alias("__rank")).drop("s", "__in")
    hits = written(per, "quantiles")
    hits = F.broadcast(hits) if hits.count() <= WANTED_ROWS else hits
    pairs = [*keys, RANGE]
    here = hits.select(*[f"__k_{k}" for k in pairs]).distinct()
    rows = t.join(here, _same(t, here, pairs), "left_semi")
    run = F.sum("__n").over(Window.partitionBy(*pairs).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*pairs, "__v", "__n", run.alias("__run"))
    found = rows.join(hits, _same(rows, hits, pairs) & (F.col("__rank") >= F.col("__run") - F.col("__n")) & (F.col("__rank") < F.col("__run")))
    at = lambda side, name: F.max(F.when((F.col("__side") == side) & (F.col("__name") == name), F.col("__v")))
    part = lambda name: F.max(F.when(F.col("__name") == name, F.col("__at") - F.floor("__at")))
    values = found.groupBy(*keys).agg(*[(at("lo", n) + (at("hi", n) - at("lo", n)) * part(n)).alias(n) for n in wanted])
    if not keys:
        return values
    values = values.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    every = t.select(*keys).distinct()
    return every.join(values, _same(every, values, keys), "left").select(*keys, *wanted)


def median(df: DataFrame, value: Column | str, name: str = "median", keys: list[str] | None = None, weight: Column | str | None = None) -> DataFrame:
    return quantiles(df, value, {name: 0.5}, keys, weight)
