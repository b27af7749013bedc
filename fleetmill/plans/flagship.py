"""The flagship query: what the fleet looks like at every unit's last cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket, clip, r6
from fleetmill.operators import features, labels
from fleetmill.sources import bindings as b


def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, n, level): units by maintenance bucket of a linear prediction from normalised, smoothed signals.

    One shuffle by unit serves labels, windows and the last row; the normalisation state is a row for each regime.
    """
    c = labels.true_rul(b.cycles(spark, sf_dir)).withColumnRenamed("op1", "regime")
    state = features.regime_norm(c.where("unit % 5 <> 0"), ["s2", "s7"])
    z = features.rolling(features.zscore(c, state, ["s2", "s7"]), ["s2_n", "s7_n"], b.WINDOW)
    last = labels.last_row(z.select("dataset", "unit", "cycle", "rul_true", "s2_n_mean", "s7_n_mean", "s7_n_slope"))
    pred = clip(66 - F.col("cycle") + 5 * F.col("s2_n_mean") - 20 * F.col("s7_n_slope"), b.CAP)
    return last.withColumn("pred", pred).groupBy(bucket("pred", b.BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("s7_n_mean")).alias("level"))
