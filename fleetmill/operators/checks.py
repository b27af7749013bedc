"""Constraint checks: each returns a table of violations, all of them together, and raises nothing by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions.columns import UNIT, unpivot


def schema(df: DataFrame, sensors: list[str], keys: tuple[str, ...] = ("unit", "cycle")) -> DataFrame:
    """(rule, column, n): missing columns, wrong types, nulls and keys below 1; one pass over the rows."""
    kinds, spark = dict(df.dtypes), df.sparkSession
    static = [("missing", c, 1) for c in (*keys, *sensors) if c not in kinds]
    static += [("type", c, 1) for c in keys if c in kinds and kinds[c] not in ("bigint", "int")]
    static += [("type", c, 1) for c in sensors if c in kinds and kinds[c] not in ("double", "float", "bigint", "int")]
    rules: list[tuple[str, str, Column]] = [("not_null", c, F.col(c).isNull()) for c in (*keys, *sensors) if c in kinds]
    rules += [("at_least_1", c, F.col(c) < 1) for c in keys if c in kinds]
    counts = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, (_, _, cond) in enumerate(rules)])
    rows = counts.select(F.stack(F.lit(len(rules)), *[x for i, (r, c, _) in enumerate(rules) for x in (F.lit(r), F.lit(c), F.col(f"r{i}"))]).alias("rule", "column", "n"))
    return rows.where("n > 0").union(spark.createDataFrame(static, "rule string, column string, n long"))


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def contiguous(df: DataFrame) -> DataFrame:
    """Units whose cycles aren't 1..n."""
    g = df.groupBy(*UNIT).agg(F.min("cycle").alias("first"), F.max("cycle").alias("last"), F.count("*").alias("n"))
    return g.where("first <> 1 or last <> n")


def history_start(df: DataFrame) -> DataFrame:
    return df.groupBy(*UNIT).agg(F.min("cycle").alias("first")).where("first <> 1")


def truth(truth: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, problem): truth below 0 or not whole, units without truth, truth without a unit."""
    j = units.select("unit", F.lit(1).alias("u")).join(truth.select("unit", "rul", F.lit(1).alias("t")), "unit", "full_outer")
    problem = F.when(F.col("t").isNull(), "no truth").when(F.col("u").isNull(), "no unit").when(F.col("rul") < 0, "negative").when(F.col("rul") != F.floor("rul"), "not whole")
    return j.select("unit", problem.alias("problem")).where("problem is not null")


def counts_vs_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, what, expected, actual) wherever the two tables (dataset, what, n) differ or lack a row."""
    a = actual.select("dataset", "what", F.col("n").alias("actual"))
    e = expected.select("dataset", "what", F.col("n").alias("expected"))
    return e.join(a, ["dataset", "what"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): null or NaN values of each column that has some."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns])
    return unpivot(counts, [], columns, "column", "n").where("n > 0")


def not_finite(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return df.where(bad).select(*keys)


def request_keys(requests: DataFrame, expected: list[str], sensors: str = "sensors") -> DataFrame:
    """Requests whose map of sensors lacks or adds names, or holds values that aren't finite."""
    want, have = F.array(*map(F.lit, expected)), F.map_keys(sensors)
    r = requests.withColumns({"missing": F.array_sort(F.array_except(want, have)), "extra": F.array_sort(F.array_except(have, want)),
                              "finite": F.forall(F.map_values(sensors), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))})
    return r.where((F.size("missing") > 0) | (F.size("extra") > 0) | ~F.col("finite"))


def min_history(df: DataFrame, least: int) -> DataFrame:
    return df.groupBy(*UNIT).agg(F.count("*").alias("n")).where(F.col("n") < least)


def state_match(state: DataFrame, regimes: int, sensors: list[str]) -> DataFrame:
    """(regime, sensor) pairs of a normalisation state that are missing or too many."""
    spark = state.sparkSession
    want = spark.range(regimes).select(F.col("id").cast("int").alias("regime"), F.explode(F.array(*map(F.lit, sensors))).alias("sensor")).withColumn("w", F.lit(1))
    have = state.select(F.col("regime").cast("int"), "sensor").distinct().withColumn("h", F.lit(1))
    return want.join(have, ["regime", "sensor"], "full_outer").where("w is null or h is null").select("regime", "sensor", F.when(F.col("h").isNull(), "missing").otherwise("extra").alias("problem"))


def points_equal(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys on one side only, or whose predictions differ by more than the tolerance."""
    j = a.select(*keys, F.col("pred").alias("pa")).join(b.select(*keys, F.col("pred").alias("pb")), keys, "full_outer")
    return j.where(F.col("pa").isNull() | F.col("pb").isNull() | (F.abs(F.col("pa") - F.col("pb")) > tolerance))


def constant_sensors(df: DataFrame, sensors: list[str], regime: str = "regime") -> DataFrame:
    """(regime, sensor, n): sensors with one value in a regime, or regimes of fewer than two rows."""
    g = df.groupBy(regime).agg(F.count("*").alias("n"), *[(F.min(s).eqNullSafe(F.max(s))).alias(s) for s in sensors])
    return unpivot(g, [regime, "n"], sensors, value="same").where("same or n < 2").select(regime, "sensor", "n")


def unseen_regimes(df: DataFrame, state: DataFrame, regime: str = "regime") -> DataFrame:
    return df.select(regime).distinct().join(state.select(regime).distinct(), regime, "left_anti")


def low_variance(df: DataFrame, sensors: list[str], cutoff: float) -> DataFrame:
    """(sensor, std) of sensors that vary less than the cutoff."""
    return unpivot(df.agg(*[F.stddev_samp(s).alias(s) for s in sensors]), [], sensors, value="std").where(F.col("std") < cutoff)
